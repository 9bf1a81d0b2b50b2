"""The JSON documents that the plans leave behind: media report, frame index, contact report, palette data, acceptance report.

Each function returns a document; :func:`siftwork.sources.sinks.write_document`
writes it. A document describes one collection and is built on the driver, as it
is read: rows are put in order by Spark and serialised there, one string a row.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import color as C
from siftwork.functions import text as T
from siftwork.operators.palette import SLOTS


def now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def _rows(df: DataFrame, order: list, columns: list[str] | None = None) -> list[dict]:
    """The rows as JSON objects, in order; null fields are kept."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]), {"ignoreNullFields": "false"})
    return [json.loads(r[0]) for r in df.orderBy(*order).select(body).collect()]


def media_report(records: DataFrame, inputs: list[str], errors: DataFrame, probe: str | None = None) -> tuple[dict, int]:
    """The report on raw media and the number of failures. ``records``: path, media_type, status and what else is known; ``errors``: path, error."""
    kinds = {r["media_type"]: r["n"] for r in records.groupBy("media_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    failed = records.filter("status = 'failed'").count()
    missing = [{"path": r["path"].rstrip("/").rsplit("/", 1)[-1], "error": r["error"]} for r in errors.orderBy("path").collect()]
    summary = {"files": sum(kinds.values()), "images": kinds.get("image", 0), "videos": kinds.get("video", 0), "unsupported": kinds.get("unsupported", 0), "failed": failed}
    media = _rows(records, [T.casefold(F.col("path")), "path"])
    return {"created_at": now(), "ffprobe": probe, "inputs": inputs, "input_errors": missing, "summary": summary, "media": media}, len(missing) + failed


def frame_index(video: str, frames: DataFrame, scene_candidates: int, uniform_candidates: int, settings: dict, reason: str | None = None) -> dict:
    """The index of a video's frames, kept and not, in order of their ids. ``frames``: frame_id, status, timestamp_ms, method and more."""
    rows = _rows(frames, ["frame_id"])
    extraction = {
        **settings, "scene_candidates": scene_candidates, "uniform_candidates": uniform_candidates, "scene_not_applicable_reason": reason if scene_candidates == 0 else None,
        "kept_count": sum(r["status"] == "kept" for r in rows), "deduplication_performed": True,
    }
    return {"created_at": now(), "video_asset_id": video, "frame_time_unit": "milliseconds", "extraction": extraction, "frames": rows}


def failed_index(video: str, error: str) -> dict:
    """The index of a video that could not be sampled."""
    return {"created_at": now(), "video_asset_id": video, "status": "failed", "error": error, "frame_time_unit": "milliseconds", "frames": []}


def contact_report(placed: DataFrame, collection: str, mode: str, settings: dict, warnings: list[str] | None = None, errors: list[str] | None = None) -> dict:
    """The record of rendered sheets. ``placed``: kind, name, page, pages, n_items, path, a row for each page."""
    sheets = placed.groupBy("kind", "name").agg(
        F.max("n_items").alias("item_count"), F.max("pages").alias("page_count"), F.transform(F.array_sort(F.collect_set(F.struct("page", "path"))), lambda x: x["path"]).alias("paths")
    )
    return {"created_at": now(), "style_pack": collection, "mode": mode, "settings": settings, "sheets": _rows(sheets, ["kind", "name"]), "warnings": warnings or [], "errors": errors or []}


def palette_document(palettes: DataFrame, counts: DataFrame, project: str, model: str, guidance: DataFrame | None = None) -> dict:
    """Palette data of all groups. ``palettes``: group, slot, role, name, hex, r, g, bl, sample_share, image_recurrence; ``counts``: group, reference_count."""
    order = F.array_position(F.array(*[F.lit(s) for s in SLOTS]), F.col("slot"))
    color = F.struct(
        "slot", "role", "name", "hex", F.array("r", "g", "bl").alias("rgb"), F.bround("sample_share", 4).alias("sample_share"), F.bround("image_recurrence", 4).alias("image_recurrence")
    )
    groups = palettes.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), color.alias("c")))), lambda x: x["c"]).alias("colors")).join(counts, "group", "left")
    title, folder = F.regexp_replace("group", "^[0-9]{2}-", ""), F.concat(F.lit("参考素材/分组/"), "group", F.lit("/00-"))
    groups = groups.join(guidance, "group", "left") if guidance is not None else groups.withColumn("color_guidance", F.col("group"))
    groups = groups.select("group", "reference_count", F.concat(folder, title, F.lit("-色卡.png")).alias("card"), F.concat(folder, title, F.lit("-纯色色卡.png")).alias("pure_card"), "color_guidance", "colors")
    return {"created_at": now(), "project": project, "card_size": [1920, 1080], "color_model": model, "groups": _rows(groups, ["group"])}


def palette_candidates(colors: DataFrame) -> DataFrame:
    """Candidates from palette data: lab, chroma and lightness of each stored colour, or why it cannot be one.

    ``colors``: rgb (array of numbers), sample_share, image_recurrence; other
    columns stay. A share that is missing counts as 0.
    """
    whole = F.transform("rgb", lambda x: x.cast("long"))
    bad = F.when(F.coalesce(F.size("rgb"), F.lit(-1)) != 3, "no rgb").when(F.exists(whole, lambda x: F.coalesce((x < 0) | (x > 255), F.lit(True))), "rgb out of range")
    lab = C.lab(F.get(whole, 0), F.get(whole, 1), F.get(whole, 2))
    out = colors.withColumn("error", bad).withColumn("lab", F.when(F.col("error").isNull(), lab))
    share = {"weight": F.coalesce("sample_share", F.lit(0.0)), "recurrence": F.coalesce("image_recurrence", F.lit(0.0))}
    return out.withColumns({**share, "chroma": C.chroma(F.col("lab")), "lightness": F.col("lab.l")})


def palette_slots(colors: DataFrame, group: str = "grp") -> DataFrame:
    """(group, error): groups whose slots are not exactly the ten, each once by name."""
    seen = colors.groupBy(group).agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    return seen.filter(F.col("slots") != F.array(*[F.lit(s) for s in sorted(SLOTS)])).select(group, F.lit(f"slots must be {' '.join(SLOTS)}").alias("error"))


def frame_items(files: DataFrame, frames: DataFrame) -> DataFrame:
    """(sheet, name, timestamp_ms, method, label) of the files of each sheet with what its frame index says of them.

    ``files``: sheet, name; ``frames``: sheet, pos, filename, status, timestamp_ms,
    method, frame_id. Only kept frames speak, of several with one filename the
    last one; what the index leaves out follows from the name.
    """
    last = frames.filter("status = 'kept'").groupBy("sheet", F.col("filename").alias("name")).agg(F.max_by(F.struct("timestamp_ms", "method", "frame_id"), "pos").alias("said"))
    own = T.frame_identity(F.col("name"))
    rows = files.join(last, ["sheet", "name"], "left").withColumn("own", own)
    pick = lambda said, usual: F.coalesce(F.col(f"said.{said}"), F.col(f"own.{usual}")).alias(usual)
    return rows.select("sheet", "name", pick("timestamp_ms", "timestamp_ms"), pick("method", "method"), pick("frame_id", "label"))


def acceptance_document(report: DataFrame, checks: DataFrame, collection: str, reviewed: bool) -> dict:
    """The acceptance report, from the one row of ``validation.report`` and the rows of ``validation.checks``."""
    row = report.first()
    counts = {r["check"]: int(r["value"]) for r in checks.orderBy("check").collect()}
    passed = row["status"] == "PASS"
    return {
        "validated_at": now(), "style_pack": collection, "status": row["status"], "automated_validation_passed": passed, "visual_review_confirmed": reviewed, "checks": counts,
        "errors": list(row["errors"]), "warnings": list(row["warnings"]),
    }
