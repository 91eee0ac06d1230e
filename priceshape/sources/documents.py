"""Large JSON documents, written and read by many tasks.

A document is one JSON object whose members are scalars and arrays of objects. Written, it is a
folder of part files that form the document when put together in the order of their names: lines
sorted by ranges, of which no task holds all. Read, it is such a folder or a single file of any size
and layout, indented or not.

A scan cuts the text at every closing brace, also inside files of one line. Whether such a piece begins
inside a string, and how deep, depends on all text before it. So each range of a file first counts its
quotes, and its braces under both assumptions about the string; running sums over the ranges (one row
each) settle which one holds and how deep each range begins; a second pass then numbers the objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceshape.scratch import pin


@dataclass(frozen=True)
class Section:
    """An array of the document: its rows become objects, ordered by a number, then a text."""

    name: str
    rows: DataFrame
    number: Column
    text: Column


def document_lines(sections: list[Section], fields: DataFrame | None = None) -> DataFrame:
    """The sorted lines of a document: ``line`` with its order columns.

    ``fields`` is a table of one row with the scalar members. The first object of an array stands on
    the line that opens it, every other begins with a comma. Columns whose names begin with ``_`` are
    left out; rows of equal order stand by their text.
    """
    order = ["section", "kind", "number", "text", "line"]
    kinds = "section int, kind int, number double, text string, line string"
    spark = sections[0].rows.sparkSession
    fixed = [(len(sections) + 1, 0, None, None, "}")]
    if fields is None:
        fixed.append((0, 0, None, None, "{"))
    parts = [spark.createDataFrame(fixed, kinds)]
    if fields is not None:
        parts.append(fields.select(
            F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).selectExpr(
            "0 AS section", "0 AS kind", "cast(NULL AS double) AS number", "cast(NULL AS string) AS text",
            "substr(line, 1, length(line) - 1) AS line"))
    for i, section in enumerate(sections, 1):
        comma = "" if i == 1 and fields is None else ","
        lines = pin(section.rows.select(
            section.number.cast("double").alias("number"), section.text.cast("string").alias("text"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in section.rows.columns if not c.startswith("_")]),
                      {"ignoreNullFields": "false"}).alias("line"),
            F.monotonically_increasing_id().alias("n")), "lines")
        first = lines.agg(F.min(F.struct("number", "text", "line", "n"))).first()[0]
        fixed = [(i, 0, None, None, f'{comma}"{section.name}": [' + (first["line"] if first else "")), (i, 2, None, None, "]")]
        parts.append(spark.createDataFrame(fixed, kinds))
        if first:
            parts.append(lines.where(F.col("n") != first["n"]).select(
                F.lit(i).alias("section"), F.lit(1).alias("kind"), "number", "text", F.concat(F.lit(","), "line").alias("line")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy(*order)


def write_document(path: str, sections: list[Section], fields: DataFrame | None = None) -> None:
    """Write a document as part files that form it in the order of their names."""
    document_lines(sections, fields).select("line").write.text(path)


#: Pieces of text as regular expressions: a whole string, and a text up to an opening brace outside strings.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_OUTSIDE = rf'[^"{{]*+(?:{_STRING}[^"{{]*+)*+'
_NAME = r'"([^"\\]*)"\s*:\s*\['


def _opened(piece: Column, inside: bool) -> Column:
    """Opening braces outside strings of a piece that begins inside a string or not."""
    if inside:  # without the rest of that string
        piece = F.regexp_replace(piece, r'(?s)\A(?:[^"\\]++|\\.)*+("|\z)', "")
    return F.length(F.regexp_replace(F.regexp_replace(piece, rf'(?s){_STRING}|".*', ""), r"(?s)[^{]", ""))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a document's arrays: ``section`` (name of the array), ``place`` (long, their order
    in the document) and ``object`` (JSON text).

    Objects may hold objects and arrays. Other members of the document are not returned. Braces,
    brackets and escaped quotes inside strings are text. A document without arrays or without text has
    no rows. The text is written to scratch twice.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    quotes = F.length(F.regexp_replace("piece", r'(?s)\\.|[^"]', ""))
    within = Window.partitionBy("file", "block").orderBy("at")
    # For a range that begins outside (0) or inside (1) a string: the depth after each piece.
    counted = raw.withColumns({"quotes": quotes, "opened0": _opened(F.col("piece"), False),
                               "opened1": _opened(F.col("piece"), True)}).withColumn("upto", F.sum("quotes").over(within))
    depths = {f"depth{s}": F.sum(F.expr(
        f"if((upto - quotes + {s}) % 2 = 0, opened0, opened1) - if((upto + {s}) % 2 = 0, 1, 0)")).over(within) for s in (0, 1)}
    pieces = pin(counted.withColumns(depths).select("file", "block", "size", "at", "piece", "upto", *depths), "pieces")
    # One row per range of a file from here on, not per piece. A file that does not end with a brace has
    # a byte less than its pieces with their braces; its last piece is open.
    last = pieces.groupBy("file", "block").agg(
        F.max_by(F.struct("upto", *depths), "at").alias("l"), F.max("at").alias("last"),
        F.sum(F.octet_length("piece") + 1).alias("bytes"), F.max("size").alias("size"),
    ).withColumn("open", F.expr("block = max(block) OVER (PARTITION BY file) AND sum(bytes) OVER (PARTITION BY file) > size"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(value: str) -> Column:
        return F.coalesce(F.sum(F.expr(value)).over(before), F.lit(0))

    starts = pin(last.withColumn("inside", sum_before("l.upto") % 2).withColumn("depth", sum_before(
        "if(inside = 0, l.depth0, l.depth1) + if(open AND (l.upto + inside) % 2 = 0, 1, 0)")).select(
        "file", "block", "inside", "depth", F.expr("if(open, last, -1)").alias("open_at")), "starts")
    ended = pieces.join(starts, ["file", "block"]).selectExpr(
        "file", "block", "at", "if(at = open_at, piece, concat(piece, '}')) AS piece",
        "if(at <> open_at AND (upto + inside) % 2 = 0 AND depth + if(inside = 0, depth0, depth1) = 1, 1, 0) AS ends").withColumn(
        "done", F.sum("ends").over(within) - F.col("ends"))
    ended = pin(ended, "ended")
    earlier = pin(ended.groupBy("file", "block").agg(F.sum("ends").alias("n")).withColumn(
        "earlier", sum_before("n")).drop("n"), "earlier")
    texts = ended.join(earlier, ["file", "block"]).groupBy((F.col("earlier") + F.col("done")).alias("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "block", "at", "piece"))),
                                 lambda p: p["piece"]), "").alias("text"))
    # The first text begins with the brace of the document itself.
    texts = texts.withColumn("text", F.expr(r"if(place = 0, regexp_replace(text, '^\\s*\\{', ''), text)")).withColumn(
        "head", F.regexp_extract("text", rf"(?s)\A({_OUTSIDE})", 1)).selectExpr(
        "place", "head", "substr(text, length(head) + 1) AS object")
    split = pin(texts, "objects")
    # A head may name several arrays, all but the last of them empty. One row per array comes here.
    name = F.try_element_at(F.regexp_extract_all("head", F.lit(_NAME)), F.lit(-1))
    names = split.select("place", name.alias("name")).where("name IS NOT NULL").orderBy("place").collect()
    section = F.lit(None).cast("string")
    for r in names:
        section = F.when(F.col("place") >= r["place"], F.lit(r["name"])).otherwise(section)
    return split.withColumn("section", section).where(
        r"object <> '' AND section IS NOT NULL AND NOT head RLIKE ':\\s*$'").selectExpr(
        "section", "place", "object")
