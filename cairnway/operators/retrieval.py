"""Free-text, structured and location-biased retrieval of features: an inverted index of words, met set at a time.

A query's words match words of the index alike, as the beginning of them, or but for one letter (both share what is left after
taking out one letter at most: a letter more, fewer, another, or moved).  A feature is retrieved if it matches all words of the
query but a quarter of them.  Posting lists are read of rare words only; what features say in common words is a pattern, which
is met once for all features that share it, and no feature is lost: there is no cap before the score.  A feature's score is the sum over the query's words of how
well and how rarely they match, more if it is near the place that the query is biased to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text
from ..sources.writers import rewritten
from .ranking import first_rows
from .spatial import first_reach, nearest

C = F.col
#: Words that carry no place.
SKIPPED = ("in", "at", "near", "the", "of", "and")
#: What a word counts that matches alike, as a beginning, or but for a letter, and how long it has to be for that.
EXACT, BEGINNING, FUZZY, LEAST_BEGINNING, LEAST_FUZZY = 1.0, 0.8, 0.6, 3, 4
#: Nearby features count up to half as much again; at zoom 18 "near" is a quarter of a kilometre, twice as far a level below.
BIAS, NEAR_KM, ZOOM = 0.5, 0.25, 10


def words(value: Column) -> Column:
    """Distinct words of a text, street types spelled out."""
    return F.array_distinct(F.filter(F.split(text.expand_street(value), r"\s+"), lambda t: ~t.isin(*SKIPPED) & (t != "")))


def feature_words() -> Column:
    return words(F.concat_ws(" ", "name", "housenumber", "street", "city", "state", "osm_value"))


def one_letter_out(word: Column) -> Column:
    """The word, and the word without each of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cut))


def dealt_out(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in as many tasks as shuffles have: adaptive execution gathers few rows in one task, however many they become in it."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


@dataclass
class Index:
    """features (fid, words, lat, lon), vocabulary (word, idf, df) and postings (word, fid), as written tables."""

    features: DataFrame
    vocabulary: DataFrame
    postings: DataFrame

    @classmethod
    def of(cls, features: DataFrame) -> Index:
        """``features``: fid, name, housenumber, street, city, state, osm_value, lat, lon; other columns are not read."""
        named = dealt_out(features.select("fid", "name", "housenumber", "street", "city", "state", "osm_value", "lat", "lon"), "fid")
        rows = rewritten(named.select("fid", feature_words().alias("words"), "lat", "lon"), "feature_words")
        postings = rewritten(rows.select(F.explode("words").alias("word"), "fid").repartition("word"), "postings")
        total = rows.count()
        vocabulary = postings.groupBy("word").agg(F.count("*").alias("df")).withColumn("idf", F.log(1.0 + F.lit(float(total)) / C("df")))
        return cls(rows, rewritten(vocabulary, "vocabulary"), postings)


def matches(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct (word) -> (word, found, worth, df): words of the index that it matches, each by its best rule."""
    long_enough = lambda c: (F.length(c) >= LEAST_FUZZY) & ~F.rlike(c, F.lit("[0-9]"))
    v = vocabulary.select(C("word").alias("found"), "df", "idf")
    alike = asked.join(v, C("word") == C("found")).select("word", "found", "df", (C("idf") * EXACT).alias("worth"))
    # A number is a number: only words are met by their beginnings.
    starts = v.where((F.length("found") > LEAST_BEGINNING) & ~F.rlike("found", F.lit("^[0-9]+$"))).select("*", F.explode(F.sequence(F.lit(LEAST_BEGINNING), F.length("found") - 1)).alias("n"))
    beginning = asked.join(starts.withColumn("word", F.left("found", C("n"))), "word").select("word", "found", "df", (C("idf") * BEGINNING).alias("worth"))
    left = asked.where(long_enough("word")).select("word", F.explode(one_letter_out(C("word"))).alias("rest"))
    right = v.where(long_enough("found")).select("found", "df", "idf", F.explode(one_letter_out(C("found"))).alias("rest"))
    fuzzy = left.join(right, "rest").where(C("word") != C("found")).select("word", "found", "df", (C("idf") * FUZZY).alias("worth"))
    return alike.unionByName(beginning).unionByName(fuzzy).groupBy("word", "found", "df").agg(F.max("worth").alias("worth"))


#: A word on more than one in so many features is common.
COMMON = 100


def free_text(asked: DataFrame, index: Index, limit: int) -> DataFrame:
    """``asked`` (qid, q, lat, lon, zoom; null coordinates: no bias) -> qid, fid, relevance and position from 0.

    Features are met by what they say in common words, their pattern, and by the rare words that they share with a query: how well
    a pattern fits a set of words is worked out once for all its features, and so are equal questions from one place.  Of a
    pattern's features at one place the first ``limit`` ids come first.  A pattern goes if ``limit`` features fit so much
    better that no nearness makes up for it, and so does a cell of its features.
    """
    q = asked.select("qid", F.array_sort(words(C("q"))).alias("text"), C("lat").alias("qlat"), C("lon").alias("qlon"), F.coalesce("zoom", F.lit(ZOOM)).alias("zoom")).where(F.size("text") > 0)
    numbered = lambda df, name, key: rewritten(df.distinct().select(F.monotonically_increasing_id().alias(key), "*"), name)
    texts = numbered(q.select("text"), "texts", "tid").withColumn("least", (F.size("text") - F.floor(F.size("text") / 4)).cast("int"))
    own = rewritten(q.join(texts.select("tid", "text"), "text").drop("text"), "asked_words")
    same = ["tid", "qlat", "qlon", "zoom"]
    places = numbered(own.select(*same), "asked_places", "pid")
    each = texts.select("tid", "least", F.explode("text").alias("word"))
    total = index.features.count()
    met = rewritten(matches(each.select("word").distinct(), index.vocabulary).withColumn("common", C("df") * COMMON > total), "met")
    hits = each.join(met, "word").select("tid", "least", "word", "found", "worth", "common")
    # At most COMMON words are common for each word that features have.
    known = met.where("common").select("found").distinct().agg(F.array_sort(F.collect_list("found")).alias("known"))
    features = rewritten(index.features.crossJoin(F.broadcast(known)).select("fid", F.array_sort(F.array_intersect("words", "known")).alias("pattern"), "lat", "lon"), "patterns")
    patterns = features.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("found", F.explode("pattern"))
    best = F.max("worth").alias("worth")
    got = F.collect_list(F.struct("word", "worth"))
    base = hits.where("common").join(patterns, "found").groupBy("tid", "least", "pattern", "n", "word").agg(best).groupBy("tid", "least", "pattern", "n").agg(got.alias("got"))
    base = rewritten(base, "pattern_fits")
    sum_of = lambda worths: F.aggregate(F.array_sort(worths), F.lit(0.0), lambda s, w: s + w)
    near = F.exp(-geo.haversine(C("lat"), C("lon"), C("qlat"), C("qlon")) / 1000.0 / (NEAR_KM * F.pow(F.lit(2.0), 18 - C("zoom"))))
    relevance = F.round(C("worth") * (1.0 + BIAS * F.coalesce(near, F.lit(0.0))), 6).alias("relevance")
    order = [F.desc("relevance"), "fid"]

    # By rare words: the pattern's share is added, the better of both where a word of the query has a rare and a common match.
    rare = hits.where("not common").join(index.postings.withColumnRenamed("word", "found"), "found").groupBy("tid", "least", "fid", "word").agg(best)
    rare = rare.groupBy("tid", "least", "fid").agg(got.alias("few")).join(features, "fid").join(base.select("tid", "pattern", "got"), ["tid", "pattern"], "left")
    every = F.concat("few", F.coalesce("got", F.array().cast("array<struct<word:string,worth:double>>")))
    worths = F.transform(F.array_distinct(F.transform(every, lambda e: e["word"])), lambda w: F.array_max(F.transform(F.filter(every, lambda e: e["word"] == w), lambda e: e["worth"])))
    rare = rare.withColumn("worths", worths).where(F.size("worths") >= C("least")).select("tid", "fid", sum_of(C("worths")).alias("worth"), "lat", "lon")
    first = first_rows(places.join(rare, "tid").select("pid", "fid", relevance), ["pid"], order, limit).drop("n")

    # By patterns alone.
    fit = base.where(F.size("got") >= C("least")).select("tid", "pattern", "n", sum_of(F.transform("got", lambda g: g["worth"])).alias("worth"))
    upto = F.sum("n").over(Window.partitionBy("tid").orderBy(F.desc("worth"), "pattern"))
    sure = F.max(F.when(C("upto") >= limit, C("worth"))).over(Window.partitionBy("tid"))
    fit = fit.withColumn("upto", upto).withColumn("sure", sure).where(C("sure").isNull() | (C("worth") * (1.0 + BIAS) >= C("sure") - 1e-5)).select("tid", "pattern", "worth", "sure")
    # Without a place to be near, a pattern's features are equally worth: its first ids are met, not all of its cells.
    plain = rewritten(first_rows(features.where(F.size("pattern") > 0), ["pattern"], ["fid"], limit).drop("n"), "pattern_firsts")
    sure_of = fit.where(C("sure").isNull() | (C("worth") >= C("sure") - 1e-5)).drop("sure")
    nowhere = C("qlat").isNull() | C("qlon").isNull()
    pairs = dealt_out(places.where(nowhere).join(sure_of, "tid"), "pid").join(plain, "pattern")
    third = first_rows(pairs.select("pid", "fid", relevance), ["pid"], order, limit).drop("n")
    fit = fit.drop("sure")
    some = rewritten(first_rows(features.where(F.size("pattern") > 0), ["pattern", "lat", "lon"], ["fid"], limit).drop("n"), "pattern_places")
    # A pattern's features by cells: a query reads the cells that may hold one of its first, told by how near and how far they can be.
    reach, whole = first_reach(some, limit, ["pattern"])
    side = max(reach, whole / 32, 1e-6)
    celled = some.withColumn("y", F.floor(C("lat") / side)).withColumn("x", F.floor(C("lon") / side))
    middle = celled.withColumn("mlat", (C("y") + 0.5) * side).withColumn("mlon", (C("x") + 0.5) * side)
    radius = F.max(geo.haversine(C("lat"), C("lon"), C("mlat"), C("mlon"))) + 1.0
    cells = middle.groupBy("pattern", "y", "x").agg(F.count("*").alias("n"), F.first("mlat").alias("mlat"), F.first("mlon").alias("mlon"), radius.alias("radius"))
    cells = rewritten(cells.select(F.monotonically_increasing_id().alias("cell"), "*"), "pattern_cells")
    celled = celled.join(cells.select("cell", "pattern", "y", "x"), [celled[c].eqNullSafe(cells[c]) for c in ("pattern", "y", "x")]).select("cell", "fid", "lat", "lon")
    away = geo.haversine(C("mlat"), C("mlon"), C("qlat"), C("qlon"))
    worth_at = lambda d: C("worth") * (1.0 + BIAS * F.coalesce(F.exp(-d / 1000.0 / (NEAR_KM * F.pow(F.lit(2.0), 18 - C("zoom")))), F.lit(0.0)))
    bounds = dealt_out(fit.join(places.where(~nowhere).select("tid").distinct(), "tid", "left_semi").join(cells, "pattern").drop("pattern"), "tid", "cell").join(places.where(~nowhere), "tid").withColumn("away", away)
    bounds = bounds.select("pid", "cell", "worth", "n", worth_at(C("away") + C("radius")).alias("low"), worth_at(F.greatest(F.lit(0.0), C("away") - C("radius"))).alias("high"))
    filled = F.sum("n").over(Window.partitionBy("pid").orderBy(F.desc("low"), "cell"))
    held = F.max(F.when(C("filled") >= limit, C("low"))).over(Window.partitionBy("pid"))
    open_ = bounds.withColumn("filled", filled).withColumn("held", held).where(C("held").isNull() | (C("high") >= C("held") - 1e-5)).select("pid", "cell", "worth")
    pairs = open_.hint("merge").join(celled, "cell").join(places, "pid")
    second = first_rows(pairs.select("pid", "fid", relevance), ["pid"], order, limit).drop("n")

    both = first.unionByName(second).unionByName(third).groupBy("pid", "fid").agg(F.max("relevance").alias("relevance"))
    ranked = first_rows(both, ["pid"], order, limit, "position").withColumn("position", C("position") - 1)
    at = own.alias("o").join(places.alias("p"), [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in same]).select("o.qid", "p.pid")
    return at.join(ranked, "pid").select("qid", "fid", "relevance", "position")


def structured(asked: DataFrame, features: DataFrame, limit: int) -> DataFrame:
    """``asked`` (qid, number, street, city, state) -> qid, fid, position: features of the street, in the city and state that the
    query names, its number first and then the nearest numbers, features without one last.

    Equal questions are one, and of features with the same number in the same street the first ``limit`` ids come first.
    """
    named = lambda c: F.upper(F.trim(c))
    q = asked.where("street is not null").select("qid", F.struct(C("number").alias("qn"), text.expand_street(C("street")).alias("road"), named(C("city")).alias("qc"), named(C("state")).alias("qst")).alias("question"))
    f = features.where("street is not null").select("fid", "housenumber", text.expand_street(C("street")).alias("road"), named(C("city")).alias("fc"), named(C("state")).alias("fst"))
    f = first_rows(f, ["road", "fc", "fst", "housenumber"], ["fid"], limit).drop("n")
    met = dealt_out(q.select("question").distinct(), "question").select("question", "question.*").join(f, "road").where((C("qc").isNull() | (C("qc") == C("fc"))) & (C("qst").isNull() | (C("qst") == C("fst"))))
    off = F.abs(text.leading_int(C("housenumber")) - text.leading_int(C("qn")))
    order = [F.when(C("housenumber") == C("qn"), 0).otherwise(1).asc(), off.asc_nulls_last(), F.col("fid")]
    best = first_rows(met, ["question"], order, limit, "position").select(C("question").alias("of"), "fid", (C("position") - 1).alias("position"))
    return q.join(best, C("question").eqNullSafe(C("of"))).select("qid", "fid", "position")


#: How far a feature of each type may be from what it names, in metres.
REACH = {"poi": 300.0, "street_address": 1000.0, "locality": 15_000.0}


def reverse(places: DataFrame, features: DataFrame, limit: int = 1, reach: dict[str, float] | None = None) -> DataFrame:
    """``places`` (qid, lat, lon) -> qid, fid, type, metres, position: the nearest features, each within the reach of its type.

    Coordinates out of range, and those without a feature in reach, have no rows.  Each type's first ``limit`` are found by growing
    rings: the first of all are among them.
    """
    fine = places.where(C("lat").between(-90, 90) & C("lon").between(-180, 180))
    kind = text.feature_type(C("osm_key"), C("osm_value"), C("type"), C("housenumber"))
    typed = features.where("lat is not null and lon is not null").select("fid", kind.alias("layer"), "lat", "lon")
    met = None
    for layer, metres in (reach or REACH).items():
        near = nearest(fine, typed.where(C("layer") == layer), limit, (metres / 16, metres / 4, metres), ["fid"], within=metres).select("qid", "fid", C("layer").alias("type"), "metres")
        met = near if met is None else met.unionByName(near)
    return first_rows(met, ["qid"], ["metres", "fid"], limit, "position").withColumn("position", C("position") - 1)
