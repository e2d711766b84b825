"""Maps: places of cells, steps and percentiles are worked out once."""

from cairnway.operators import routing
from cairnway.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_numbered_once_without_texts_of_bits(spark):
    told = plan(registry.queries()["edge_cost"](spark, "/root/testdata/sf0.001"))
    assert "regexp_replace" not in told and "conv(" not in told


def test_a_pair_of_cells_is_met_once_and_costs_are_not_in_the_join(spark):
    rows = [(r, c, float(3 * r + c), 1.0 + c, 0, 0) for r in range(3) for c in range(4)]
    found = routing.edges(spark.createDataFrame(rows, "r int, c int, elev_m double, mult double, trail int, barrier int"), "foot", 30.0)
    assert not [line for line in plan(found).splitlines() if "ShuffledHashJoin" in line and "CASE" in line]
    assert plan(found).count("[-1,") == 0
    steps = {(e.r, e.c, e.r2, e.c2) for e in found.collect()}
    assert steps == {(r, c, r + a, c + b) for r, c, *_ in rows for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and 0 <= r + a < 3 and 0 <= c + b < 4}


def test_percentiles_read_their_rows_once(spark):
    assert plan(registry.queries()["fn_unified_layers"](spark, "/root/testdata/sf0.001")).count("orders.parquet") <= 1


def test_few_rows_that_become_many_are_dealt_to_many_tasks(spark, tmp_path):
    """Features' words, cells of patterns and streets' questions: no task gets all that a small table becomes."""
    from cairnway.operators import retrieval

    few = spark.range(8, numPartitions=1).withColumnRenamed("id", "tid")
    out = retrieval.dealt_out(few, "tid").selectExpr("tid", "explode(sequence(1, 100)) as n").groupBy("tid").count()
    assert out.count() == 8 and retrieval.dealt_out(few, "tid").rdd.getNumPartitions() > 1
    kinds = [(i, f"shop {i}", None, None, "Boise", "ID", "cafe", 43.0, -117.0) for i in range(40)]
    features = spark.createDataFrame(kinds, "fid long, name string, housenumber string, street string, city string, state string, osm_value string, lat double, lon double").coalesce(1)
    index = retrieval.Index.of(features)
    assert len(index.features.inputFiles()) > 1 and index.features.count() == 40


def test_books_are_read_entry_by_entry(spark, monkeypatch):
    """Entries, broken and odd texts as a whole load has them; no text is loaded whole unless it names itself."""
    from cairnway.sources import readers

    texts = ["entries:\n- &a {name: x, id: 1, aliases: [A]}\n- *a\n- {id: 2}", "entries: [{", "- a", "", "entries: [{name: x}]\nentries: [{name: y}]", "a: 1\n---\nb: 2", "b: &b [{name: z, lat: 1.5}]\nentries: *b", "entries: [{name: q}]\nx: *gone", "<<: {entries: [{name: m}]}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "book int, text string")
    found = readers.yaml_books(rows, "text")
    assert "MapInArrow" in plan(found)
    told = sorted((r.book, r.entry, r.name, r.id, r.lat, r.problem) for r in found.collect())
    assert told == [(0, 0, "x", "1", None, None), (0, 1, "x", "1", None, None), (0, 2, None, None, None, "no name"), (1, 0, None, None, None, "no book"), (2, 0, None, None, None, "no book"),
                    (4, 0, "y", None, None, None), (5, 0, None, None, None, "no book"), (6, 0, "z", None, 1.5, None), (7, 0, None, None, None, "no book"), (8, 0, "m", None, None, None)]
