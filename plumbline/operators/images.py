"""Figure panels: segmentation, features, candidate pairs, pair scores, risk tiers.

Candidates are joined on features alone (``candidates``); pixels join again for the pairs that are scored. Corners and their descriptors are made
once for each panel that is in some pair, and pairs are matched by them (``functions.keypoints``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import keypoints as K
from plumbline.functions import pixels as P
from plumbline.operators.candidates import MAX_PAIRS, candidate_pairs, cosine, hamming, recall_score
from plumbline.sources.store import numbered, stored

FEATURES = "panel_id string, image_id string, source_path string, page int, bbox array<int>, width int, height int, gray binary, dhash bigint, phash bigint, edge_hist array<float>, figure_id string, panel_path string"
BENIGN = {
    "whole_panel_reuse": ["shared control panel", "same source shown twice by design"],
    "cropped_reuse": ["declared inset", "zoomed region of the same image"],
    "transformed_reuse": ["re-oriented display of one image", "declared reuse"],
    "local_clone": ["periodic sample structure", "compression or stitching artefact"],
    "weak_visual_similarity": ["same instrument and staining", "plain background"],
}
#: What a reviewer may do next, in our own words.
SUGGESTIONS = {
    "whole_panel_reuse": "Ask whether one picture is shown twice by design, as a shared control is.",
    "cropped_reuse": "See whether one panel is said to be an inset of the other; if not, look at the uncut pictures.",
    "transformed_reuse": "See whether turning or mirroring is described; if not, compare the source pictures.",
    "local_clone": "Look at the marked patches in the uncompressed picture.",
    "weak_visual_similarity": "A weak lead: leave it unless other records disagree as well.",
}


def _registered(found: DataFrame) -> DataFrame:
    return found.select("image.*").select(F.sha2("origin", 256).substr(1, 16).alias("image_id"), F.col("origin").alias("source_path"), F.lit("standalone_image").alias("kind"), F.lit(None).cast("int").alias("page"), "height", "width", F.col("nChannels").alias("n_channels"), "data")


def register_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, source_path, kind, page, height, width, n_channels, data) of the images in a folder; what can't be decoded is left out."""
    return _registered(spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path))


def register_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As ``register_images``, for files that are named."""
    return _registered(spark.read.format("image").option("dropInvalid", "true").load(paths))


def _segmented(split: bool, most: int, folder: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                gray = P.luma(np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.n_channels))
                boxes = [P.content_box(gray)]
                if split and r.kind == "pdf_page":
                    boxes += P.component_boxes(gray, max(12000, int(gray.size * 0.015)), most)
                number = 0
                for x0, y0, x1, y1 in dict.fromkeys(boxes):
                    crop = np.ascontiguousarray(gray[y0:y1, x0:x1])
                    if not P.informative(crop):
                        continue
                    number += 1
                    page = None if pd.isna(r.page) else int(r.page)
                    rows.append((f"{r.image_id}-{number:03d}", r.image_id, r.source_path, page, [x0, y0, x1, y1], x1 - x0, y1 - y0, crop.tobytes(), P.dhash(crop), P.phash(crop), P.edge_histogram(crop).tolist(), "", f"{folder}/{r.image_id}-{number:03d}.png" if folder else None))
            out = pd.DataFrame(rows, columns=[f.strip().split()[0] for f in FEATURES.split(", ")])
            yield out.astype({"page": "Int32"})

    return run


def panels(images: DataFrame, split_pages: bool = False, most: int = 80, folder: str | None = None) -> DataFrame:
    """Panels of images with their gray pixels and features; panel_path is where in the folder their pixels go as a file."""
    return images.mapInPandas(_segmented(split_pages, most, folder), FEATURES)


def correlation(a: Column, b: Column) -> Column:
    """Cosine of two vectors less their means."""
    centred = lambda x: F.transform(x, lambda v: v.cast("double") - F.aggregate(x, F.lit(0.0), lambda s, w: s + w.cast("double")) / F.size(x))
    return cosine(centred(a), centred(b))


PAIR = (
    "panel_id_a string, panel_id_b string, ncc double, ssim double, orientation string, template_ncc double, template_direction string, template_bbox array<int>, overlap_ratio double, "
    "keypoint_matches int, ransac_inliers int, inlier_ratio double, feature_transform string, matrix array<array<double>>, rotation_degrees double, scale_x double, scale_y double"
)
DETECTOR = "corners"


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [K.described(np.frombuffer(g, dtype=np.uint8).reshape(h, w)) for g, h, w in zip(batch["gray"], batch["height"], batch["width"], strict=True)]
        yield pd.DataFrame({"panel_id": batch["panel_id"], **{name: [x[i].tobytes() for x in found] for i, name in enumerate(("places", "bits", "mirrored"))}})


def described(found: DataFrame) -> DataFrame:
    """(panel_id, places, bits, mirrored): corners of panels, some 70 KB each at most."""
    return found.select("panel_id", "gray", "height", "width").mapInPandas(_described, "panel_id string, places binary, bits binary, mirrored binary")


def _corners(r, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = lambda name: np.frombuffer(getattr(r, f"{name}_{side}"), dtype=np.uint8).reshape(-1, K.BITS // 8)
    return np.frombuffer(getattr(r, f"places_{side}"), dtype=np.float32).reshape(-1, 2), bits("bits"), bits("mirrored")


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            a, b = (np.frombuffer(g, dtype=np.uint8).reshape(h, w) for g, h, w in ((r.gray_a, r.height_a, r.width_a), (r.gray_b, r.height_b, r.width_b)))
            ncc, ssim, orientation = P.whole(a, b)
            found = P.template(a, b)
            rows.append((r.panel_id_a, r.panel_id_b, ncc, ssim, orientation, found["ncc"], found["direction"], found["bbox"], min(a.size, b.size) / max(a.size, b.size), *K.matched(_corners(r, "a"), _corners(r, "b")).values()))
        yield pd.DataFrame(rows, columns=[f.strip().split()[0] for f in PAIR.split(", ")])


def pair_verdict(df: DataFrame) -> DataFrame:
    """match_type, transform and score of compared pairs: later rules rename, the score only grows."""
    whole = (F.col("ncc") >= 0.93) & (F.col("ssim") >= 0.82)
    cropped = (F.col("template_ncc") >= 0.86) & (F.col("overlap_ratio") < 0.9)
    turned = (F.col("ransac_inliers") >= 18) & (F.col("inlier_ratio") >= 0.35)
    zero = F.lit(0.0)
    score = F.greatest(
        F.when(whole, 92 + 6 * F.least("ncc", F.lit(1.0))).otherwise(zero), F.when(cropped, 78 + 18 * F.col("template_ncc")).otherwise(zero),
        F.when(turned, 74 + F.least("ransac_inliers", F.lit(80)) * 0.25 + F.col("inlier_ratio") * 12).otherwise(zero),
    )
    kind = F.when(cropped, "cropped_reuse").when(turned, "transformed_reuse").when(whole, "whole_panel_reuse").otherwise("weak_visual_similarity")
    transform = F.when(turned, F.col("feature_transform")).when(cropped, F.concat(F.lit("template_"), F.col("template_direction"))).otherwise(F.col("orientation"))
    return df.withColumn("match_type", kind).withColumn("transform", transform).withColumn("score", F.round(F.least(score, F.lit(100.0)), 2))


#: What a finding says of each of its panels.
TOLD = {"source_path": "source", "page": "page", "figure_id": "figure_id", "panel_path": "panel_path"}


def _with_sources(scored: DataFrame, found: DataFrame) -> DataFrame:
    """Findings with the source, page, figure and file of both panels."""
    for side in ("a", "b"):
        told = found.select(F.col("panel_id").alias(f"panel_id_{side}"), *[F.col(c).alias(f"{name}_{side}") for c, name in TOLD.items()])
        scored = scored.join(told, f"panel_id_{side}")
    return scored


def score_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of panels with all metrics, the kind of match and its score. Corners are made once a panel, of those in some pair."""
    pairs = stored(pairs.select("panel_id_a", "panel_id_b"), "pairs")
    asked = pairs.select(F.explode(F.array("panel_id_a", "panel_id_b")).alias("panel_id")).distinct()
    corners = stored(described(found.join(asked, "panel_id")), "corners")
    every = found.select("panel_id", "gray", "width", "height").join(corners, "panel_id")
    side = lambda s: every.select(*[F.col(c).alias(f"{c}_{s}") for c in every.columns])
    both = pairs.join(side("a"), "panel_id_a").join(side("b"), "panel_id_b")
    compared = pair_verdict(both.mapInPandas(_compared, PAIR)).withColumn("detector", F.lit(DETECTOR))
    feature = F.struct("detector", "keypoint_matches", "ransac_inliers", "inlier_ratio", F.col("feature_transform").alias("transform"), "matrix", "rotation_degrees", "scale_x", "scale_y")
    template = F.struct("template_ncc", "template_direction", "template_bbox")
    details = F.to_json(F.struct(feature.alias("feature"), template.alias("template"), F.col("orientation").alias("whole_orientation")))
    return _with_sources(compared.withColumn("details", details), found)


CLONE = "panel_id string, similarity double, box_a array<int>, box_b array<int>"


def _cloned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            best = P.local_clone(np.frombuffer(r.gray, dtype=np.uint8).reshape(r.height, r.width))
            if best:
                rows.append((r.panel_id, best["similarity"], *best["boxes"]))
        yield pd.DataFrame(rows, columns=["panel_id", "similarity", "box_a", "box_b"])


def local_clones(found: DataFrame) -> DataFrame:
    """Panels with two much alike patches, as pairs of the panel with itself."""
    clones = found.select("panel_id", "gray", "width", "height").mapInPandas(_cloned, CLONE)
    pairs = clones.select(F.col("panel_id").alias("panel_id_a"), F.col("panel_id").alias("panel_id_b"), F.lit("local_clone").alias("match_type"), F.round(70 + 25 * F.col("similarity"), 2).alias("score"), "similarity", "box_a", "box_b")
    return _with_sources(pairs, found)


def risk_tier() -> Column:
    kind, score, inliers = F.col("match_type"), F.col("score"), F.col("ransac_inliers")
    high = (
        ((kind == "whole_panel_reuse") & (F.col("ncc") >= 0.95) & (F.col("ssim") >= 0.85))
        | ((kind == "cropped_reuse") & (F.col("template_ncc") >= 0.9))
        | ((kind == "transformed_reuse") & (inliers >= 30) & (F.col("inlier_ratio") >= 0.45))
        | ((kind == "local_clone") & (score >= 92))
    )
    return F.when(high, "High").when((score >= 72) | (inliers >= 16) | (F.col("template_ncc") >= 0.82), "Medium").otherwise("Low")


def normalize_images(findings: DataFrame, min_risk: str = "Low") -> DataFrame:
    """Findings of at least a tier, ranked by tier and score. findings: (panel_id_a, panel_id_b, match_type, score and the metrics)."""
    order = F.create_map(*[F.lit(x) for pair in {"Low": 1, "Medium": 2, "High": 3}.items() for x in pair])
    filled = findings
    for name, kind in (("ncc", "double"), ("ssim", "double"), ("template_ncc", "double"), ("inlier_ratio", "double"), ("ransac_inliers", "int")):
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast(kind)) if name in findings.columns else F.lit(0).cast(kind))
    tiers = filled.withColumn("risk_tier", risk_tier()).where(order[F.col("risk_tier")] >= order[F.lit(min_risk)])
    benign = F.create_map(*[x for k, v in BENIGN.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
    numbers = numbered(tiers, [F.desc("score"), F.col("panel_id_a"), F.col("panel_id_b")], "_number").withColumn("finding_id", F.format_string("image-%05d", "_number"))
    ranked = numbered(numbers.withColumn("_tier", order[F.col("risk_tier")]), [F.desc("_tier"), F.desc("score"), F.col("panel_id_a"), F.col("panel_id_b")], "normalized_rank")
    suggestions = F.create_map(*[F.lit(x) for pair in SUGGESTIONS.items() for x in pair])
    kind = F.col("match_type")
    return ranked.drop("_number", "_tier").withColumn("benign_explanations_checked", benign[kind]).withColumn("review_suggestion", F.coalesce(suggestions[kind], F.lit(SUGGESTIONS["weak_visual_similarity"])))


def image_findings(images: DataFrame, max_pairs: int = MAX_PAIRS, min_score: float = 60.0, with_clones: bool = False, split_pages: bool = False) -> DataFrame:
    """From images to findings of at least min_score."""
    found = stored(panels(images, split_pages), "panels")
    scored = score_pairs(found, candidate_pairs(found, max_pairs)).where(F.col("score") >= min_score)
    return scored.unionByName(local_clones(found), allowMissingColumns=True) if with_clones else scored
