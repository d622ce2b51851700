"""Readers of the input formats, each to a DataFrame; none brings a file to the driver but its first line."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions import geo, text

# Column names met in input files, and ours.
ALIASES = {
    "фио": "fio",
    "ф.и.о": "fio",
    "адрес": "address",
    "адрес регистрации": "address",
    "паспорт": "passport",
    "сумма": "debt_amount",
    "сумма долга": "debt_amount",
    "сумма иска": "debt_amount",
    "claim_amount": "debt_amount",
    "дата": "contract_date",
    "дата договора": "contract_date",
    "широта": "lat",
    "latitude": "lat",
    "долгота": "lng",
    "lon": "lng",
    "longitude": "lng",
    "тип дела": "case_type",
    "id дела": "id",
    "номер договора": "contract_number",
}
DEBTOR = ("id", "contract_number", "fio", "address", "passport", "debt_amount", "contract_date", "case_type", "lat", "lng")
NUMBERS = ("debt_amount", "lat", "lng")
#: Encodings of text files in the order in which they are tried.
ENCODINGS = ("utf-8", "windows-1251", "iso-8859-1")


def canonical(df: DataFrame) -> DataFrame:
    """Columns under their canonical names; of several aliases of one the first filled value counts."""
    by_name: dict[str, list[Column]] = {}
    for c in df.columns:
        name = c.lstrip("\ufeff").strip().lower()
        by_name.setdefault(ALIASES.get(name, name), []).append(F.col(f"`{c}`").cast("string"))
    values = {n: text.first_filled(*by_name[n]) if n in by_name else F.lit(None).cast("string") for n in DEBTOR}
    return df.select(*[(text.number(v) if n in NUMBERS else v).alias(n) for n, v in values.items()])


def debtors_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """Rows that have a name or an address."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding)
    return canonical(raw).filter(text.not_blank(F.col("fio")) | text.not_blank(F.col("address")))


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with valid coordinates and their row number in their own file, the header's being 1.

    Files are read in blocks, as large ones are split; a line's number is its place in the
    block after the lines of the blocks before it, which are counted first. The separator
    is that of a file's first line.
    """
    at = {"path": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")}
    lines = spark.read.text(path).select("value", *[c.alias(n) for n, c in at.items()]).withColumn("id", F.monotonically_increasing_id())
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")).select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = lines.join(blocks, ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("pos"), F.col("value").alias("line"))
    heads = placed.filter("pos = 0").select("path", F.regexp_replace("line", "^\ufeff", "").alias("head"))
    numbered = placed.filter("pos > 0 AND trim(line) <> ''").join(heads, "path")
    # separators inside quotes part nothing
    apart = lambda sep: f'{sep}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    parts = lambda c: F.when(F.contains("head", F.lit(";")), F.split(c, apart(";"))).otherwise(F.split(c, apart(",")))
    cells = lambda c: F.transform(parts(c), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))
    keyed = numbered.select("path", (F.col("pos") + 1).cast("long").alias("row_number"), F.transform(cells(F.col("head")), F.lower).alias("names"), cells(F.col("line")).alias("cells"))
    named = {}
    for name in DEBTOR:
        known = [k for k, v in ALIASES.items() if v == name] + [name]
        pairs = F.filter(F.arrays_zip("names", "cells"), lambda p: p["names"].isin(known) & text.not_blank(p["cells"]))  # noqa: B023
        value = F.get(pairs, F.lit(0))["cells"]
        named[name] = (text.number(value) if name in NUMBERS else value).alias(name)
    rows = keyed.select(*named.values(), "row_number")
    return rows.filter(geo.valid_point(F.col("lat"), F.col("lng")))


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """fio, address, lat, lng, case_type, debt_amount and row_number (from 1) of the Point features of a collection."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:variant>,properties:variant>>"
    f = spark.read.json(path, schema=schema, multiLine=True).select(F.posexplode("features").alias("pos", "f"))
    at = lambda i: F.try_variant_get("f.geometry.coordinates", f"$[{i}]", "double")
    prop = lambda *names: F.coalesce(*[F.try_variant_get("f.properties", f"$.{n}", "string") for n in names])
    points = f.filter("f.geometry.type = 'Point'").select(
        prop("fio", "name").alias("fio"),
        prop("address").alias("address"),
        at(1).alias("lat"),
        at(0).alias("lng"),
        F.coalesce(prop("case_type", "тип_дела"), F.lit("")).alias("case_type"),
        prop("debt_amount", "сумма").try_cast("double").alias("debt_amount"),
        (F.col("pos") + 1).cast("long").alias("row_number"),
    )
    return points.filter(geo.valid_point(F.col("lat"), F.col("lng")))


def geojson_areas(spark: SparkSession, path: str) -> DataFrame:
    """area_id, name, section_num and outer ring of polygons; of a multipolygon the first part."""
    content = spark.read.format("binaryFile").load(path).select(decoded(F.col("content")).alias("json"))
    v = F.try_parse_json("json")
    features = F.coalesce(F.try_variant_get(v, "$.features", "array<variant>"), F.array(v))
    f = content.select(F.posexplode(features).alias("pos", "f"))
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    ring = F.when(kind == "Polygon", F.try_variant_get("f", "$.geometry.coordinates[0]", "array<array<double>>")).when(
        kind == "MultiPolygon", F.try_variant_get("f", "$.geometry.coordinates[0][0]", "array<array<double>>")
    )
    prop = lambda *names: text.first_filled(*[F.try_variant_get("f", f"$.properties.{n}", "string") for n in names])
    name = prop("name", "title", "court_name")
    section = F.coalesce(prop("section_num", "number", "district_number").try_cast("int"), text.section_number(name))
    shaped = f.select(F.xxhash64("pos", name).alias("area_id"), name.alias("name"), section.alias("section_num"), F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))
    return shaped.filter(F.size("ring") >= 3)


def decoded(content: Column) -> Column:
    """Bytes to text by the first of ENCODINGS under which they make sense, without a byte order mark."""

    @F.pandas_udf("string")
    def other(contents):
        def one(raw):
            for encoding in ENCODINGS:
                try:
                    return raw.decode(encoding)
                except UnicodeDecodeError:
                    continue

        return contents.map(one, na_action="ignore")

    plain = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(F.coalesce(plain, other(content)), "^﻿", "")


def kml_points(spark: SparkSession, path: str) -> DataFrame:
    """name, lat, lng of Placemarks."""
    schema = "name string, Point struct<coordinates:string>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    parts = F.split(F.trim("Point.coordinates"), ",")
    points = rows.select("name", F.try_element_at(parts, F.lit(2)).try_cast("double").alias("lat"), F.try_element_at(parts, F.lit(1)).try_cast("double").alias("lng"))
    return points.filter(geo.valid_point(F.col("lat"), F.col("lng")))


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of the first sheet of each workbook; a workbook is one task's."""

    def run(batches):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        def tag(e):
            return e.tag.rpartition("}")[2]

        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                book = zipfile.ZipFile(io.BytesIO(content))
                shared = []
                if "xl/sharedStrings.xml" in book.namelist():
                    shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
                sheet = min(n for n in book.namelist() if n.startswith("xl/worksheets/sheet"))
                for number, row in enumerate((e for e in ElementTree.fromstring(book.read(sheet)).iter() if tag(e) == "row"), 1):
                    cells: list = []
                    for c in row:
                        column = 0
                        for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                            column = column * 26 + ord(letter) - 64
                        cells += [None] * (column - 1 - len(cells))
                        value = "".join(e.text or "" for e in c.iter() if tag(e) in ("v", "t"))
                        cells.append(shared[int(value)] if c.get("t") == "s" and value else value or None)
                    out.append((name, number, cells))
            yield pd.DataFrame(out, columns=["path", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row int, cells array<string>")


def debtors_xlsx(spark: SparkSession, path: str) -> DataFrame:
    rows = xlsx_rows(spark, path)
    header = rows.filter("row = 1").first()
    names = [c or f"c{i}" for i, c in enumerate(header["cells"])] if header else []
    flat = rows.filter("row > 1").select(*[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return canonical(flat).filter(text.not_blank(F.col("fio")) | text.not_blank(F.col("address")))


def debtors(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": debtors_csv, "xlsx": debtors_xlsx, "geojson": geojson_points, "json": geojson_points, "kml": kml_points}
    if suffix not in readers:
        raise ValueError(f"unknown format: {suffix}")
    return readers[suffix](spark, path)


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file that holds a list; other items are dropped."""
    return spark.read.option("mode", "DROPMALFORMED").json(path, schema=schema, multiLine=True)


def latest_file(spark: SparkSession, path: str) -> str | None:
    """The newest file under a pattern."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", "modificationTime")).first()[0]


def courts_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, sep=";")
    names = {"регион": "region", "район": "district", "участок": "section_num", "название": "court_name", "адрес": "address", "индекс": "postal_index", "координаты": "coordinates"}
    picked = {}
    for c in raw.columns:
        low = c.strip().lower().lstrip("﻿")
        picked.setdefault(names.get(low, low), F.col(f"`{c}`"))
    out = ["region", "district", "section_num", "court_name", "address", "postal_index", "coordinates"]
    values = {n: text.blank_to_null(picked[n]) if n in picked else F.lit(None).cast("string") for n in out}
    return raw.select(*[(v.try_cast("int") if n == "section_num" else v).alias(n) for n, v in values.items()])


def law_rules_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rules in the order of files and lines; blank rows are dropped, and so are rules whose pattern is no regular expression.

    rule_order is the file's place by name and then the row's place in its file.
    """
    schema = "section_num string, region string, area_text string, street_pattern string, house_from string, house_to string, house_parity string, house_suffix string, house_step string, law_reference string"
    raw = spark.read.csv(path, header=True, sep=";", schema=schema).withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "nth": F.monotonically_increasing_id()})
    rules = raw.withColumns({c: text.whole_number(F.col(c)) for c in ("house_from", "house_to", "house_step")})
    filled = rules.filter(text.not_blank(F.col("street_pattern")) | text.not_blank(F.col("area_text")))
    # rules are a dimension of some thousands of rows, so one window over their order will do
    order = F.row_number().over(Window.orderBy("file", "block", "nth"))
    return valid_patterns(filled).withColumn("rule_order", (order - 1).cast("long")).drop("file", "block", "nth")


def valid_patterns(rules: DataFrame) -> DataFrame:
    @F.pandas_udf("boolean")
    def compiles(patterns):
        import re

        def good(p):
            try:
                re.compile(p or "")
            except re.error:
                return False
            return True

        return patterns.map(good)

    return rules.filter(compiles(F.coalesce("street_pattern", F.lit(""))))


def positional_csv(spark: SparkSession, path: str, columns: dict[str, int | list[int]], sep: str = ";") -> DataFrame:
    """Columns by their place, without quotes and blanks around; of several places the filled ones, with a comma between (phones).

    Files are decoded whole, by the first of ENCODINGS that fits.
    """
    content = spark.read.format("binaryFile").load(path).select(F.explode(F.split(decoded(F.col("content")), "\r?\n")).alias("value"))
    lines = content.filter(text.not_blank(F.col("value")))
    parts = F.split("value", sep)
    at = lambda i: text.blank_to_null(F.replace(F.try_element_at(parts, F.lit(i + 1)), F.lit('"'), F.lit("")))
    joined = {n: F.array_join(F.array_compact(F.array(*map(at, i))), ", ") if isinstance(i, list) else F.coalesce(at(i), F.lit("")) for n, i in columns.items()}
    return lines.select(*[c.alias(n) for n, c in joined.items()])


def contact_files(spark: SparkSession, path: str) -> DataFrame:
    """Section, phone and e-mail of files of one record each."""
    content = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))
    c = F.col("text")
    return content.select(
        "path",
        text.section_number(c).alias("section"),
        text.first_group(c, r"([\w.+-]+@[\w-]+\.[\w.]+)").alias("email"),
        text.first_group(c, r"(?iu)(?:тел\.?|телефон)\s*:?\s*([+\d][\d ()\-]{5,})").alias("phone"),
    )


def resource_tree(spark: SparkSession, nodes: DataFrame, root: int, deepest: int = 100) -> DataFrame:
    """id, parent, depth of all nodes under a root; nodes: id, parent."""
    return spark.sql(
        f"""WITH RECURSIVE tree(id, parent, depth) AS (
          SELECT id, parent, 0 FROM {{nodes}} WHERE id = {int(root)}
          UNION ALL SELECT n.id, n.parent, t.depth + 1 FROM {{nodes}} n JOIN tree t ON n.parent = t.id WHERE t.depth < {int(deepest)})
        SELECT * FROM tree""",
        nodes=nodes,
    )


def seed_priority(spark: SparkSession, catalogue: str, dumps: str, schema: str, newest: int = 3) -> DataFrame:
    """The named objects of a catalogue's file, else of the first that has any among the newest files under a pattern.

    Files that are missing, unreadable or without named objects count as empty.
    """
    from pyspark.errors import AnalysisException

    def files() -> list[str]:
        try:
            found = spark.read.format("binaryFile").load(dumps).select("path", "modificationTime")
            return [catalogue, *(r.path for r in found.orderBy(F.desc("modificationTime"), "path").limit(newest).collect())]
        except AnalysisException:
            return [catalogue]

    for path in files():
        try:
            named = json_list(spark, path, schema).filter(text.not_blank(F.col("name")))
            if not named.isEmpty():
                return named
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def unwrapped(response: Column) -> Column:
    """The items of an API's answer: a list, or what is under features, data, items or results."""
    v = F.try_parse_json(response)
    paths = ("$.features", "$.data", "$.items", "$.results", "$")
    return F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths], F.array().cast("array<variant>"))


class _Cells(HTMLParser):
    """Rows of table cells, and the text outside scripts and styles."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.text: list[str] = []
        self.cell, self.skip = False, 0

    def handle_starttag(self, name, attrs):
        if name in ("script", "style"):
            self.skip += 1
        elif name == "tr":
            self.rows.append([])
        elif name in ("td", "th"):
            self.cell = True
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        elif name in ("p", "br", "div", "li", "h1", "h2", "h3"):
            self.text.append("\n")

    def handle_endtag(self, name):
        if name in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif name in ("td", "th"):
            self.cell = False

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.cell and self.rows and self.rows[-1]:
                self.rows[-1][-1] += data


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, row, cells of all table rows of pages."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for k, page in zip(batch[key], batch[html]):
                parser = _Cells()
                parser.feed(page or "")
                out += [(k, i, [c.strip() for c in row]) for i, row in enumerate(parser.rows) if row]
            yield pd.DataFrame(out, columns=["key", "row", "cells"])

    return pages.select(key, html).mapInPandas(run, f"key {dict(pages.dtypes)[key]}, row int, cells array<string>")


def html_text(html: str) -> Column:
    """The text of a page, a line for each block."""

    @F.pandas_udf("string")
    def plain(pages):
        import re

        def one(page):
            if page is None:
                return None
            parser = _Cells()
            parser.feed(page)
            lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(parser.text).split("\n")]
            return "\n".join(x for x in lines if x)

        return pages.map(one)

    return plain(html)


def section_texts(texts: DataFrame) -> DataFrame:
    """doc, section, district, body: a document's text cut at its section headings, with the last district heading above."""
    parts = F.split("text", r"(?iu)(?=участок\s*№\s*\d+)")
    cut = texts.select("doc", F.posexplode(parts).alias("pos", "body"))
    heading = text.first_group(F.col("body"), r"(?iu)([А-ЯЁа-яё\-]+\s+район)\s*$")
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = cut.withColumn("district", F.last(heading, ignorenulls=True).over(w))
    section = F.regexp_extract("body", r"(?iu)^участок\s*№\s*(\d+)", 1).try_cast("int")
    return named.withColumn("section", section).filter("section IS NOT NULL").select("doc", "section", "district", "body")
