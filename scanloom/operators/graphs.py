"""Distance graphs of instances, and the descriptors made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KITTI, Config
from ..functions.vectors import TINY
from ..plans.store import dealt

# Class pairs of the blocks of the graph descriptor, in order.
BLOCKS = ((1, 1), (2, 2), (3, 3), (2, 3), (1, 2), (1, 3))


def _guarded(norm: F.Column) -> F.Column:
    return F.when(norm == 0, F.lit(TINY)).otherwise(norm)


def links(instances: DataFrame, config: Config = KITTI) -> DataFrame:
    """All ordered pairs of a scan's instances nearer than edge_limit, each with
    itself included: (scan_id, src, dst, src_cls, dst_cls, dist, bin)."""
    a = instances.select("scan_id", *[F.col(c).alias(f"src_{c}") for c in ("node_id", "cls", "cx", "cy", "cz")])
    b = instances.select("scan_id", *[F.col(c).alias(f"dst_{c}") for c in ("node_id", "cls", "cx", "cy", "cz")])
    d2 = sum(((F.col(f"src_{c}") - F.col(f"dst_{c}")) * (F.col(f"src_{c}") - F.col(f"dst_{c}")) for c in ("cx", "cy", "cz")), F.lit(0.0))
    joined = a.join(b, "scan_id").withColumn("dist", F.sqrt(d2)).where(F.col("dist") < config.edge_limit)
    number = (F.col("dist") / F.lit(float(config.edge_bin))).cast("int")
    return joined.select(
        "scan_id", F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"), "src_cls", "dst_cls", "dist", number.alias("bin")
    )


def edges(linked: DataFrame) -> DataFrame:
    return linked.where("src < dst")


def class_counts(instances: DataFrame) -> DataFrame:
    names = {1: "n_vehicle", 2: "n_trunk", 3: "n_pole"}
    return instances.groupBy("scan_id").agg(*[F.count_if(F.col("cls") == c).alias(n) for c, n in names.items()])


def node_histograms(linked: DataFrame, config: Config = KITTI) -> DataFrame:
    """Non-zero slots of each node's edge lengths by class, L2-normalised."""
    slot = ((F.col("dst_cls") - 1) * config.edge_bins + F.col("bin")).alias("slot")
    counts = linked.groupBy("scan_id", F.col("src").alias("node_id"), slot).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("scan_id", "node_id")))
    return counts.select("scan_id", "node_id", "slot", (F.col("n") / _guarded(norm)).alias("value"))


def graph_histograms(linked: DataFrame, counts: DataFrame, config: Config = KITTI) -> DataFrame:
    """Non-zero slots of a scan's graph descriptor: class counts, then the edge
    lengths of class pairs; both parts and the whole L2-normalised."""
    block = F.lit(None).cast("int")
    low, high = F.least("src_cls", "dst_cls"), F.greatest("src_cls", "dst_cls")
    for i, (a, b) in enumerate(BLOCKS):
        block = F.when((low == a) & (high == b), F.lit(i)).otherwise(block)
    slots = edges(linked).select("scan_id", (3 + block * config.edge_bins + F.col("bin")).alias("slot")).groupBy("scan_id", "slot").agg(F.count("*").alias("n"))
    heads = counts.select("scan_id", F.posexplode(F.array("n_vehicle", "n_trunk", "n_pole")).alias("slot", "n")).where("n > 0")
    every = slots.unionByName(heads).withColumn("head", F.col("slot") < 3)
    n2 = F.col("n") * F.col("n")
    part = F.sqrt(F.sum(n2).over(Window.partitionBy("scan_id", "head")))
    first = every.withColumn("value", F.col("n") / _guarded(part))
    whole = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("scan_id")))
    return first.select("scan_id", "slot", (F.col("value") / _guarded(whole)).alias("value"))


def spectral(adjacency: np.ndarray, size: int) -> np.ndarray:
    """Absolute eigenvectors by falling absolute eigenvalue, size columns (padded
    with zeros), each row divided by its sum."""
    values, vectors = np.linalg.eigh(adjacency)
    order = np.argsort(-np.abs(values), kind="stable")[:size]
    out = np.zeros((len(adjacency), size))
    out[:, : len(order)] = np.abs(vectors[:, order])
    total = out.sum(axis=1, keepdims=True)
    return out / np.where(total == 0, 1.0, total)


def node_descriptors(instances: DataFrame, config: Config = KITTI) -> DataFrame:
    """Per node: histogram and spectral half as one array. A group is one scan."""
    bins, size = config.edge_bins, config.spectral_size

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id", ignore_index=True)
        centres = pdf[["cx", "cy", "cz"]].to_numpy()
        dist = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
        near = dist < config.edge_limit
        hist = np.zeros((len(pdf), 3 * bins))
        i, j = np.nonzero(near)
        np.add.at(hist, (i, (pdf.cls.to_numpy()[j] - 1) * bins + (dist[i, j] / config.edge_bin).astype(int)), 1)
        norm = np.sqrt((hist**2).sum(axis=1, keepdims=True))
        desc = np.hstack([hist / np.where(norm == 0, TINY, norm), spectral(near.astype(float), size)])
        return pdf.assign(desc=list(desc))

    schema = "scan_id bigint, node_id int, cls int, cx double, cy double, cz double, dx double, dy double, dz double, n bigint, desc array<double>"
    columns = [x.split()[0] for x in schema.split(", ")]
    return dealt(instances.select(*columns[:-1]), "scan_id").groupBy("scan_id").applyInPandas(lambda pdf: run(pdf)[columns], schema)
