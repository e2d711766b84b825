"""Readers: text formats and nested documents as DataFrames; bad records are counted, never fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

C = F.col
POINT = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
ENTITY = "id string, labels map<string,struct<value:string>>, claims map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>, sitelinks map<string,struct<title:string>>"


def nested_parquet(spark: SparkSession, path: str, columns: dict[str, str], bbox=None, at=("lat", "lon")) -> DataFrame:
    """Project (nested) columns under new names; a (south, north, west, east) box reaches the Parquet scan as a filter."""
    df = spark.read.parquet(path)
    if bbox:
        s, n, w, e = bbox
        df = df.where(C(at[0]).between(s, n) & C(at[1]).between(w, e))
    return df.select(*[C(source).alias(name) for name, source in columns.items()])


def geojson_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """RFC 8142 records, one a line (a leading record separator goes): ``feature`` and ``ok``."""
    text = F.regexp_replace(C(column), "^[\x1e\\s]+", "")
    feature = F.from_json(text, POINT)
    return lines.withColumn("feature", feature).withColumn("ok", feature.isNotNull() & feature["type"].isNotNull())


def feature_collection(documents: DataFrame, column: str, kind: str = "LineString") -> DataFrame:
    """Features of one geometry type from whole FeatureCollection texts."""
    collection = F.from_json(C(column), f"features array<struct<{'type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>'}>>")
    out = documents.withColumn("feature", F.explode(collection["features"]))
    return out.where(C("feature.geometry.type") == kind)


def entity_fields(documents: DataFrame, column: str) -> DataFrame:
    """Label, first valid population, classes and article of entity documents."""
    e = F.from_json(C(column), ENTITY)
    values = lambda p: F.transform(F.try_element_at(e["claims"], F.lit(p)), lambda c: c["mainsnak"]["datavalue"]["value"])
    population = F.get(F.filter(F.transform(values("P1082"), lambda v: F.regexp_replace(v, r"^\+", "").try_cast("long")), lambda n: n.isNotNull()), 0)
    return documents.select("*", e["id"].alias("entity"), F.try_element_at(e["labels"], F.lit("en"))["value"].alias("label"), population.alias("population"), values("P31").alias("classes"), F.try_element_at(e["sitelinks"], F.lit("enwiki"))["title"].alias("article"))


def catalog_entries(documents: DataFrame, column: str, prefixes: list[tuple[str, str]]) -> DataFrame:
    """Entries of an Atom catalog whose name starts with a known prefix: source and content path.

    The path is what follows /content/ in an entry's first text/html link; entries without one are left out.
    """
    entry = "//*[local-name()='entry'][*[local-name()='name']][starts-with(*[local-name()='link'][@type='text/html'][1]/@href, '/content/')]"
    names = F.xpath(C(column), F.lit(entry + "/*[local-name()='name'][1]/text()"))
    links = F.xpath(C(column), F.lit(entry + "/*[local-name()='link'][@type='text/html'][1]/@href"))
    out = documents.select("*", F.explode(F.arrays_zip(names.alias("name"), links.alias("href"))).alias("e")).select(*documents.columns, "e.name", "e.href")
    source = F.lit(None).cast("string")
    for prefix, label in reversed(prefixes):
        source = F.when(F.startswith("name", F.lit(prefix)), label).otherwise(source)
    return out.withColumn("source", source).where("source is not null").withColumn("path", F.substr("href", F.lit(len("/content/") + 1))).where("path <> ''").drop("href")


BOOK = "id string, name string, aliases array<string>, address string, lat double, lon double, tags array<string>"


def yaml_books(documents: DataFrame, column: str) -> DataFrame:
    """Address books, a YAML text each: one row an entry with its number in the book, aliases in lower case; ``problem`` where a text is
    no book or an entry has no name, which costs that text or entry only."""

    def entries(text: str, row) -> list[tuple]:
        """``row`` of each entry, one after the other: no more than one is a tree of nodes at a time; aliases reach back to earlier ones."""
        import yaml
        from yaml.composer import Composer
        from yaml.constructor import SafeConstructor
        from yaml.resolver import Resolver

        try:
            from yaml.cyaml import CParser
        except ImportError:
            Events = yaml.SafeLoader  # noqa: N806
        else:

            class Events(Composer, CParser, SafeConstructor, Resolver):
                def __init__(self, stream):
                    CParser.__init__(self, stream)
                    for part in (Composer, SafeConstructor, Resolver):
                        part.__init__(self)

        it, rows = Events(text), []
        plain = lambda kind: it.check_event(kind) and it.peek_event().anchor is None and it.peek_event().tag is None
        whole = lambda: [row(e) for e in (yaml.safe_load(text) or {}).get("entries") or []]
        it.get_event()
        if it.check_event(yaml.StreamEndEvent):
            return rows
        it.get_event()
        if not plain(yaml.MappingStartEvent):
            return whole()
        it.get_event()
        while not it.check_event(yaml.MappingEndEvent):
            if not plain(yaml.ScalarEvent) or it.peek_event().value == "<<":
                return whole()
            key = it.construct_document(it.compose_node(None, None))
            if key == "entries" and plain(yaml.SequenceStartEvent):
                it.get_event()
                rows = []
                while not it.check_event(yaml.SequenceEndEvent):
                    rows.append(row(it.construct_document(it.compose_node(None, None))))
                it.get_event()
            else:
                value = it.construct_document(it.compose_node(None, None))
                rows = [row(e) for e in value or []] if key == "entries" else rows
        for _ in ("mapping", "document"):
            it.get_event()
        if not it.check_event(yaml.StreamEndEvent):
            raise yaml.YAMLError("more than one document")
        return rows

    def run(batches):
        import pyarrow as pa
        import yaml

        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.string()]
        number = lambda v: float(v) if isinstance(v, (int, float)) else None
        words = lambda v: [str(x) for x in v] if isinstance(v, list) else []
        shown = lambda v: None if v is None else str(v)

        def row(e) -> tuple:
            if not isinstance(e, dict) or not e.get("name"):
                return (None,) * 7 + ("no name",)
            return shown(e.get("id")), str(e["name"]), [a.lower() for a in words(e.get("aliases"))], shown(e.get("address")), number(e.get("lat")), number(e.get("lon")), words(e.get("tags")), None

        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    rows = entries(batch.column(column)[i].as_py() or "", row)
                except (yaml.YAMLError, AttributeError):
                    rows = [(None,) * 7 + ("no book",)]
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    told = [batch.column(c).take(pa.array([i] * len(some))) for c in kept]
                    told.append(pa.array(range(at, at + len(some)), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*told, *[pa.array([r[k] for r in some], kind) for k, kind in enumerate(kinds)]], names=[*kept, *names])

    kept = [c for c in documents.columns if c != column]
    told = StructType([documents.schema[c] for c in kept] + StructType.fromDDL(f"entry int, {BOOK}, problem string").fields)
    names = told.names[len(kept) :]
    # A text is one row, however long: adaptive execution would gather many in a task.
    many = documents.repartition(max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return many.mapInArrow(run, told)


MANIFEST = "version int, path string, tile_dbs array<struct<name:string,path:string,chunk_bounds:struct<min_x:bigint,max_x:bigint,min_y:bigint,max_y:bigint>>>"


def manifest(documents: DataFrame, column: str, folder: str = "folder") -> DataFrame:
    """Tile manifests (a text each, and the folder it lies in): one row a declared table, in order, with its path and chunk bounds.

    Version 1 lists tables, relative paths are the folder's; a document without a version that names one path is of the legacy kind: one
    table of that path without bounds.  ``problem`` tells what else there was: text that is no manifest, or another version.
    """
    m = F.from_json(C(column), MANIFEST)
    legacy = F.array(F.struct(F.lit("legacy").alias("name"), C("m.path").alias("path"), F.lit(None).cast("struct<min_x:bigint,max_x:bigint,min_y:bigint,max_y:bigint>").alias("chunk_bounds")))
    known = F.when(C("m.version") == 1, C("m.tile_dbs")).when(C("m.version").isNull() & C("m.path").isNotNull(), legacy)
    problem = F.when(C("m.version").isNull() & C("m.path").isNull(), "no manifest").when(C("m.version").isNotNull() & (C("m.version") != 1), "unknown version")
    rows = documents.withColumn("m", m).select(*documents.columns, problem.alias("problem"), F.posexplode_outer(known).alias("ord", "d"))
    path = F.when(F.startswith("d.path", F.lit("/")) | F.contains("d.path", F.lit("://")), C("d.path")).otherwise(F.concat_ws("/", folder, "d.path"))
    return rows.select(*[c for c in documents.columns if c != column], "problem", "ord", C("d.name").alias("name"), F.when(C("d.path").isNotNull(), path).alias("path"), *[C(f"d.chunk_bounds.{k}").alias(k) for k in ("min_x", "max_x", "min_y", "max_y")])
