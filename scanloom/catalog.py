"""Every query of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import queries as q
from .plans.oracles import ORACLES

NAMES = (
    "knn_exclusion_topk knn_pivot_topk knn_padded_candidates knn_top1_label_recall pr_threshold_sweep pr_average_precision pr_auc pr_score_ranked "
    "pr_score_summary cosine_pairs_gated l2_normalize file_name_pad label_remap fg_points bg_points spherical_coords spherical_voxels "
    "voxel_downsample_first voxel_cap5 neighbor27_nn tilt_correction cluster_components noise_clusters instance_boxes instance_boxes_checked "
    "instance_edges class_counts node_edge_hist graph_edge_hist spectral_node_desc scan_descriptor polar_grid ring_occupancy grid_similarity "
    "triangle_pruning kabsch_moments kabsch_pose_error icp_normal_equations plane_moments rigid_transform rte_rre pose_success_rate "
    "pose_inverse alignment_fit_score size_gated_pairs hungarian_match assignment_totals ransac_pose ransac_matched_pose icp_pose icp_rounds_pose plane_normals plane_pairs plane_icp_pose loop_similarity loop_pose "
    "sequence_retrieval stream_retrieval stream_shuffled_retrieval"
).split()

QUERIES = {name: getattr(q, name) for name in NAMES}

__all__ = ["ORACLES", "QUERIES"]
