"""Force-main layers and the hand-written lists that go with them."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.quality import first_reason
from tributary.sources.decisions import decode


@dataclass(frozen=True)
class Rules:
    """Which mains are kept. The values are fixed ones, the published defaults."""

    lifecycle: tuple[str, ...] = ("Active",)
    exclude_owner: tuple[str, ...] = ("PVT",)
    min_diameter_in: float | None = 4.0
    exclude_comment: tuple[str, ...] = ("bypass port", "by-pass port", "bypass pumping", "by-pass pumping", "bypass pump pipe", "emergency bypass")
    exclude_facilityid: tuple[str, ...] = ()


def drop_reasons(rules: Rules, geom: str = "geom") -> list[tuple[str, Column]]:
    """The rules in their order as (reason, condition) on FACILITYID, LIFECYCLES, OWNER, DIAMETER, COMMENT and the geometry."""
    out: list[tuple[str, Column]] = []
    size = F.col("DIAMETER").cast("string").try_cast("double")
    if rules.lifecycle:
        out.append((f"lifecycle not in {list(rules.lifecycle)}", ~F.coalesce(F.col("LIFECYCLES").isin(*rules.lifecycle), F.lit(False))))
    if rules.exclude_owner:
        out.append((f"owner in {list(rules.exclude_owner)}", F.col("OWNER").isin(*rules.exclude_owner)))
    if rules.min_diameter_in is not None:
        out += [("diameter missing", size.isNull()), ("diameter of 0, which is missing too", size == 0), (f"diameter below {rules.min_diameter_in:g}", size < rules.min_diameter_in)]
    out += [(f"comment has {p!r}", F.contains(F.lower(F.coalesce(F.col("COMMENT"), F.lit(""))), F.lower(F.lit(p)))) for p in rules.exclude_comment]
    if rules.exclude_facilityid:
        out.append((f"id in {sorted(rules.exclude_facilityid)}", F.col("FACILITYID").cast("string").isin(*rules.exclude_facilityid)))
    return [*out, ("no geometry", F.col(geom).isNull())]


def load_mains(layer: DataFrame, rules: Rules = Rules(), geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the layer's rows that no rule drops, and (reason, n, facilityids) of the others, each charged to the first rule that drops it.

    facilityids lists up to 20 ids in order; reasons come in the rules' order (ord).
    """
    reasons = drop_reasons(rules, geom)
    d = layer.withColumn("_reason", first_reason(reasons))
    place = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(reasons) for x in (name, k)])
    gone = d.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), least_ids("FACILITYID").alias("facilityids"))
    return d.where("_reason IS NULL").drop("_reason"), gone.select(place[F.col("reason")].alias("ord"), "reason", "n", "facilityids")


def least_ids(name: str, n: int = 20) -> Column:
    """Up to n distinct values as text, least first, joined by commas."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(F.col(name).cast("string"))), 1, n), ", ")


def _table(spark: SparkSession, path: str) -> tuple[list[str], list[dict[str, str]]]:
    """Header and rows of a hand-written CSV; a header that occurs twice gets a number behind it."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    rows = list(csv.reader(io.StringIO(decode(bytes(raw.content)))))
    head: list[str] = []
    for name in (h.strip() for h in (rows[0] if rows else [])):
        again = sum(h == name or h.startswith(f"{name}.") for h in head)
        head.append(f"{name}.{again}" if again else name)
    return head, [dict(zip(head, [c.strip() for c in r] + [""] * len(head))) for r in rows[1:] if any(c.strip() for c in r)]


def _exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _numbers(row: dict[str, str], names: tuple[str, ...], line: int, path: str) -> list[float]:
    try:
        return [float(row[n]) for n in names]
    except (KeyError, ValueError):
        raise ValueError(f"{path}, line {line}: {' and '.join(names)} must be numbers") from None


def read_joins(spark: SparkSession, path: str | None) -> DataFrame:
    """(ord, x, y, radius) of confirmed joins; a blank or zero radius is 5; no file gives no rows."""
    rows = []
    for k, row in enumerate(_table(spark, path)[1] if _exists(spark, path) else []):
        x, y = _numbers(row, ("x", "y"), k + 2, path)
        (radius,) = _numbers(row, ("radius_ft",), k + 2, path) if row.get("radius_ft") else (0.0,)
        rows.append((k, x, y, radius or 5.0))
    return spark.createDataFrame(rows, "ord long, x double, y double, radius double")


def read_rulings(spark: SparkSession, path: str | None) -> DataFrame:
    """(ord, x, y, classification, comment) of reviewers' rulings; blank ones are skipped, other words raise; no file gives no rows."""
    rows = []
    for k, row in enumerate(_table(spark, path)[1] if _exists(spark, path) else []):
        word = row.get("classification", "")
        if not word:
            continue
        if word not in ("wetwell", "discharge", "terminal"):
            raise ValueError(f"{path}, line {k + 2}: classification {word!r} isn't wetwell, discharge or terminal")
        rows.append((k, *_numbers(row, ("x", "y"), k + 2, path), word, row.get("comment", "")))
    return spark.createDataFrame(rows, "ord long, x double, y double, classification string, comment string")


def read_links(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(comp, wet_x, wet_y, out_x, out_y) of the force-main edges to wire; None without a path.

    FileNotFoundError if the path names no file, ValueError if columns lack.
    """
    if not path:
        return None
    if not _exists(spark, path):
        raise FileNotFoundError(f"no force-main edges at {path}; make them first, or take the setting out")
    head, rows = _table(spark, path)
    if lack := {"wetwell_x", "wetwell_y", "discharge_x", "discharge_y"} - set(head):
        raise ValueError(f"{path}: columns {sorted(lack)} are missing")
    out = [(int(float(r.get("comp_id") or k)), *_numbers(r, ("wetwell_x", "wetwell_y", "discharge_x", "discharge_y"), k + 2, path)) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, "comp long, wet_x double, wet_y double, out_x double, out_y double")


def read_prior(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(fm_x, fm_y, note) of rows decided before; None without a file or rows.

    Every column whose name begins with decision counts; their texts are joined by a
    bar. Rows without a text or with places that are no numbers are left out.
    """
    head, rows = _table(spark, path) if _exists(spark, path) else ([], [])
    if not rows:
        return None
    if not {"fm_x", "fm_y"} <= set(head):
        raise ValueError(f"{path}: fm_x and fm_y are needed to tell which ends the decisions mean")
    out = []
    for r in rows:
        note = " | ".join(r[h] for h in head if h.lower().startswith("decision") and r[h])
        try:
            place = float(r["fm_x"]), float(r["fm_y"])
        except ValueError:
            continue
        if note:
            out.append((*place, note))
    return spark.createDataFrame(out, "fm_x double, fm_y double, note string")
