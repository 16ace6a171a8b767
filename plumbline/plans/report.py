"""Reports for people: Markdown in Chinese, bar charts and evidence canvases as SVG. All on the driver, from limited and ordered rows."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import HIGH, NOT_APPLICABLE, WEAK

# Limits of the lists, and words of the report.
TOP, RAW_TOP, EXCLUDED_TOP, LEADS_TOP = 50, 30, 20, 20
TIERS = {HIGH: "高置信异常线索", WEAK: "弱异常线索", NOT_APPLICABLE: "不适用"}
METHODS = {
    "last_digit_distribution": "末位数字分布", "decimal_tail_regularity": "小数尾部规律", "duplicate_values": "重复数值", "duplicate_rows": "重复行", "clone_vector": "克隆列",
    "arithmetic_or_over_smooth_sequence": "等差或过度平滑序列", "benford_first_digit": "首位数字分布", "formula_mismatch": "公式不一致", "summary_math_inconsistency": "汇总统计不一致",
}
STATUS = {
    "missing_auditable_original_data": "没有可审计的原始数据；这不代表数据没有问题。", "no_auditable_numeric_columns": "没有可审计的数值列。", "no_statistical_hits": "数值列已审计，没有统计命中。", "auditable_numeric_data_present": "数值列已审计。",
}


def table(head: list[str], rows: list[list[object]]) -> str:
    clean = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(map(clean, r)) + " |" for r in [head, ["---"] * len(head), *rows]])


def bars_svg(counts: dict[str, int], title: str) -> str:
    top = max([1, *counts.values()])
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{40 * len(counts) + 40}" height="180"><text x="10" y="16" font-size="12">{title}</text>']
    for i, (name, n) in enumerate(counts.items()):
        h = 120 * n / top
        parts.append(f'<rect x="{20 + 40 * i}" y="{150 - h:.1f}" width="28" height="{h:.1f}" fill="#4477aa"/><text x="{26 + 40 * i}" y="166" font-size="11">{name}</text>')
    return "".join(parts) + "</svg>"


def png(gray: np.ndarray) -> bytes:
    """A PNG of a 2-d uint8 array."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(gray))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _evidence(details: dict) -> list[list[object]]:
    return [[e.get("cell"), e.get("row_index"), e.get("value", e.get("values"))] for e in details.get("evidence_examples") or [] if isinstance(e, dict)]


def _block(r: dict, folder: Path) -> str:
    details = json.loads(r["details"] or "{}")
    lines = [f"### {r['normalized_rank']}. {METHODS.get(r['method'], r['method'])}：{r['table_name']} / {r['column']}", "", f"- 层级：{TIERS[r['disposition']]}；得分 {r['score']}；n = {r['n']}；来源 {r['source_path']}", f"- {r['summary']}"]
    counts = details.get("counts") or details.get("top_tails")
    if counts and r["method"] in ("last_digit_distribution", "decimal_tail_regularity"):
        name = f"{r['finding_id']}.svg"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(bars_svg(counts, r["method"]), encoding="utf-8")
        lines.append(f"- ![{r['method']}](evidence_plots/{name})")
    if rows := _evidence(details):
        lines += ["", table(["单元格", "行", "值"], rows)]
    return "\n".join([*lines, f"- 需要先排除的解释：{'、'.join(r['benign_explanations_checked'])}", ""])


def render(screened: dict[str, DataFrame], out_dir: str, benchmark: dict | None = None, top: int = TOP, raw_top: int = RAW_TOP) -> str:
    """Writes report.md and its plots; returns the Markdown."""
    folder = Path(out_dir)
    folder.mkdir(parents=True, exist_ok=True)
    summary = screened["summary"].first().asDict()
    of = lambda tier, n: [r.asDict(recursive=True) for r in screened["normalized"].where(F.col("disposition") == tier).orderBy("normalized_rank").limit(n).collect()]
    parts = ["# 数值数据统计筛查报告", "", "线索用于人工复核，不构成不端行为的结论。", "", STATUS[summary["source_data_status"]], "", table(["层级", "数量"], [[TIERS[HIGH], summary["high_confidence_count"]], [TIERS[WEAK], summary["weak_anomaly_count"]], [TIERS[NOT_APPLICABLE], summary["not_applicable_count"]]]), ""]
    for tier, n in ((HIGH, top), (WEAK, raw_top)):
        parts += [f"## {TIERS[tier]}", "", *([_block(r, folder / "evidence_plots") for r in of(tier, n)] or ["无。", ""])]
    excluded = screened["normalized"].where(F.col("disposition") == NOT_APPLICABLE)
    kinds = [[r["column_type"], r["n"]] for r in excluded.groupBy("column_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "column_type").collect()]
    shown = [[r["table_name"], r["column"], METHODS.get(r["method"], r["method"])] for r in of(NOT_APPLICABLE, min(raw_top, EXCLUDED_TOP))]
    parts += ["## 已排除", "", table(["列类型", "数量"], kinds), "", table(["表", "列", "方法"], shown), "", "## 上下文线索", ""]
    leads = screened["leads"].orderBy("context_rank").limit(LEADS_TOP).collect()
    parts += [table(["优先级", "得分", "说明"], [[r["priority"], r["context_score"], r["summary"]] for r in leads]), ""]
    if benchmark:
        parts += ["## 基准评估", "", table(["指标", "值"], [[k, v] for k, v in benchmark.items()]), ""]
    parts += ["## 局限", "", "- 仅依据公开数据；舍入、仪器分辨率与导出格式都可能造成规律。", "- 没有命中不代表数据没有问题。", ""]
    text = "\n".join(parts)
    (folder / "report.md").write_text(text, encoding="utf-8")
    return text


def evidence_canvas(a: np.ndarray, b: np.ndarray, boxes: list[tuple[int, list[int]]], footer: str) -> str:
    """Two panels side by side with boxes, as SVG with the pixels inside. boxes: (0 or 1, [x0, y0, x1, y1])."""
    height = 300
    out, x = [], 0.0
    places = []
    for gray in (a, b):
        scale = height / gray.shape[0]
        data = base64.b64encode(png(gray)).decode()
        out.append(f'<image x="{x:.1f}" y="0" width="{gray.shape[1] * scale:.1f}" height="{height}" href="data:image/png;base64,{data}"/>')
        places.append((x, scale))
        x += gray.shape[1] * scale + 20
    for side, (x0, y0, x1, y1) in boxes:
        at, s = places[side]
        out.append(f'<rect x="{at + x0 * s:.1f}" y="{y0 * s:.1f}" width="{(x1 - x0) * s:.1f}" height="{(y1 - y0) * s:.1f}" fill="none" stroke="#cc3311" stroke-width="3"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{x:.0f}" height="{height + 30}">{"".join(out)}<text x="4" y="{height + 20}" font-size="13">{footer}</text></svg>'


def render_images(normalized: DataFrame, panels: DataFrame, out_dir: str, top: int = TOP) -> str:
    """Writes image_report.md, an evidence canvas for each of the first findings, and image_findings.json; returns the Markdown."""
    folder = Path(out_dir)
    (folder / "evidence").mkdir(parents=True, exist_ok=True)
    rows = [r.asDict(recursive=True) for r in normalized.orderBy("normalized_rank").limit(top).collect()]
    wanted = sorted({r[k] for r in rows for k in ("panel_id_a", "panel_id_b")})
    pixels = {r["panel_id"]: np.frombuffer(r["gray"], dtype=np.uint8).reshape(r["height"], r["width"]) for r in panels.where(F.col("panel_id").isin(wanted)).select("panel_id", "gray", "height", "width").collect()}  # 2 * top panels at most
    parts = ["# 图像复用筛查报告", "", "线索用于人工复核，不构成不端行为的结论。", ""]
    for r in rows:
        boxes = [(0, r["box_a"]), (1, r["box_b"])] if r.get("box_a") else [(1 if r.get("template_direction") == "a_in_b" else 0, r["template_bbox"])] if r.get("template_bbox") and r["match_type"] == "cropped_reuse" else []
        name = f"evidence/{r['finding_id']}.svg"
        (folder / name).write_text(evidence_canvas(pixels[r["panel_id_a"]], pixels[r["panel_id_b"]], boxes, f"{r['match_type']} {r['score']}"), encoding="utf-8")
        r["evidence_images"] = [name]
        parts += [f"## {r['normalized_rank']}. {r['risk_tier']}：{r['match_type']}", "", f"- {r['panel_id_a']} / {r['panel_id_b']}；得分 {r['score']}", f"- ![]({name})", f"- 需要先排除的解释：{'、'.join(r['benign_explanations_checked'] or [])}", ""]
    text = "\n".join(parts)
    (folder / "image_report.md").write_text(text, encoding="utf-8")
    (folder / "image_findings.json").write_text(json.dumps({"image_findings": rows}, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return text
