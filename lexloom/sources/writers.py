"""Writers of the file formats. Spark's output commit makes each of them appear whole or not at all."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cell, note_text

LEXICON_COLUMNS = ["headword", "variants", "gloss_en", "gloss_fr", "pos", "source_key", "source_page", "kamloops", "notes"]


def tsv(rows: DataFrame, path: str, order: list, columns: list[str], mode: str = "overwrite", files: int | None = None) -> None:
    """Columns as cells of tab-separated files with a header, globally sorted over the files; files=1 for a small list in one file."""
    out = rows.orderBy(*order).select(*(cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns))
    if files:
        out = out.coalesce(files)
    out.write.mode(mode).csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def lexicon(rows: DataFrame, path: str, sources: list[str], **options) -> None:
    """Entries by headword and the place of their source; variants joined by bars, notes in their order."""
    place = F.array_position(F.array(*(F.lit(s) for s in sources)), F.col("source_key"))
    flat = rows.withColumns(
        {
            "__place": place,
            "variants": F.array_join(F.transform("variants", lambda v: F.translate(v, "|", "/")), "|"),
            "kamloops": F.when(F.col("kamloops"), "yes").otherwise("no"),
            "notes": note_text(F.col("notes")),
        }
    )
    tsv(flat, path, ["headword", "__place"], LEXICON_COLUMNS, **options)


def merged(rows: DataFrame, path: str, columns: list[str], **options) -> None:
    """Merged rows by headword, with their phonetic keys and up to ten other headwords that share them. rows: see operators/dictionaries.merged."""
    from ..functions.text import skeleton
    from ..operators.lexicon import MOST_SIBLINGS, in_clusters

    known = in_clusters(rows.where("n_sources > 0").select("headword"))
    place = F.row_number().over(Window.partitionBy("skeleton").orderBy("headword"))
    firsts = known.withColumn("__n", place).where(F.col("__n") <= MOST_SIBLINGS + 1).groupBy("skeleton").agg(F.array_sort(F.collect_list("headword")).alias("__members"))
    keyed = rows.withColumn("skeleton", skeleton(F.col("headword"))).join(firsts, "skeleton", "left")
    siblings = F.slice(F.array_remove(F.coalesce("__members", F.array().cast("array<string>")), F.col("headword")), 1, MOST_SIBLINGS)
    tsv(keyed.withColumns({"skeleton_siblings": F.array_join(siblings, "|"), "kamloops": F.when(F.col("flagged"), "yes").otherwise("no")}), path, ["headword"], columns, **options)


def json_pages(rows: DataFrame, path: str, parts: list[str], mode: str = "overwrite") -> None:
    """Nested rows as JSON, in a folder for each value of the parts (book, leaf)."""
    rows.write.mode(mode).partitionBy(*parts).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Rows added to a JSON-lines ledger."""
    rows.write.mode("append").json(path)


def catalogue(spark: SparkSession, sources: DataFrame, counts: DataFrame, path: str) -> None:
    """Sources with their numbers of rows as YAML text. sources: (key, title, author, year); a row for each source, so the text is small."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    rows = sources.join(counts, "key", "left").orderBy("key")
    text = F.concat(F.lit("  "), F.col("key"), F.lit(":\n    title: "), quoted("title"), F.lit("\n    author: "), quoted("author"), F.lit("\n    year: "), quoted("year"), F.lit("\n    n_rows: "), F.coalesce("n", F.lit(0)).cast("string"))
    head = spark.createDataFrame([("sources:",)], "value string")
    head.unionAll(rows.select(text.alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def packed_pages(crops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): the word images of each page as one packed file. crops: line, idx, box, h, w, pixels."""

    def pack(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["line", "idx"])
        out = io.BytesIO()
        np.savez_compressed(
            out,
            flat=np.frombuffer(b"".join(page["pixels"]), np.uint8),
            shapes=page[["h", "w"]].to_numpy(np.int32).reshape(-1, 2),
            boxes=np.array([list(b) for b in page["box"]], np.int32).reshape(-1, 4),
            line=page["line"].to_numpy(np.int32),
            index=page["idx"].to_numpy(np.int32),
        )
        return pd.DataFrame([{**page[keys].iloc[0].to_dict(), "content": out.getvalue()}])

    kinds = dict(crops.dtypes)
    return crops.groupBy(*keys).applyInPandas(pack, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", content binary")


def unpack_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The crops of packed pages (keys, content)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                with np.load(io.BytesIO(row["content"])) as page:
                    shapes, flat = page["shapes"], page["flat"]
                    ends = np.cumsum(shapes.prod(axis=1)) if len(shapes) else np.zeros(0, int)
                    out = pd.DataFrame({"line": page["line"], "idx": page["index"], "box": list(page["boxes"]), "h": shapes[:, 0], "w": shapes[:, 1]})
                    out["pixels"] = [flat[b - h * w : b].tobytes() for b, h, w in zip(ends, shapes[:, 0], shapes[:, 1], strict=True)]
                    yield out.assign(**{k: row[k] for k in keys})[[*keys, "line", "idx", "box", "h", "w", "pixels"]]

    kinds = dict(pages.dtypes)
    return pages.mapInPandas(unpack, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", line int, idx int, box array<int>, h int, w int, pixels binary")


def pages_of_rows(rows: DataFrame, page: list[str], order: list, first: str = "ord") -> DataFrame:
    """rows with line, their place in the page by their sequence number, or the order of the file where there is none."""
    from ..operators.ordering import numbered

    return numbered(rows, page, [F.coalesce(*[F.col(c) for c in order], F.col(first)), first], "line")
