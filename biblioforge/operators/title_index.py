"""Title search over an index that is written once.

A work answers a reference if their titles share tokens of half the weight of the lighter one's
at least; the best five of each source by the weight shared count. Weights are whole millionths
of a logarithm, so sums of them do not depend on their order.

Works of a source with the same tokens are one class (of which only the five smallest ids can
be among the best five), and so are references. In each class tokens are in order of weight.
The first token that a pair shares lies before the point where one of the titles has less than
half its weight left: that side leads, and only led keys of either side are joined, references'
with all works and works' with all references. A token that more than ``FREQUENT`` classes hold is
no key alone; it grows by the next token, and again while that is frequent. Works that share
exactly a frequent key with a reference are all alike, so the first five of them are enough. So no
key joins more than ``FREQUENT`` classes, nothing is capped and no pair is lost.

A source's filters (OpenAlex the year, PubMed the first author) are facets: part of class and key.

The pairs of a reference grow with the works, so a search takes its references' classes in slices,
one after the other; only the best five of each stay.

The index is tables in buckets: weights by token, classes by class, keys and frequent keys by key.
A search shuffles references only. It may stay over runs (``open_index``) and serves all tiers.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..schemas import REGISTRY
from ..storage import delete, discard, forget_bucketed, keep, read_bucketed, shared_path, write_bucketed

PER_SOURCE = 5
#: Classes that hold a key beyond which it grows by another token.
FREQUENT = 100
#: Classes of references that a search works on at a time: pairs of theirs are on disk at once.
PER_SLICE = 500_000

_TABLES = {
    "weights": ("source STRING, token STRING, df LONG, idf LONG", ["source", "token"]), "totals": ("source STRING, unseen LONG", ["source"]),
    "classes": ("class LONG, source STRING, weight LONG, wk ARRAY<LONG>, ids ARRAY<STRING>", ["class"]),
    "keys": ("key LONG, class LONG, weight LONG, rest LONG, lead BOOLEAN", ["key"]), "frequent": ("key LONG, class LONG, alone BOOLEAN", ["key"]),
}


@dataclass(frozen=True)
class TitleIndex:
    """Where an index is, its buckets, and how many tokens its longest frequent key has."""

    path: str
    buckets: int
    depth: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return read_bucketed(spark, f"{self.path}/{name}", *_TABLES[name], self.buckets)

    def drop(self, spark: SparkSession) -> None:
        for name, (_, by) in _TABLES.items():
            forget_bucketed(spark, f"{self.path}/{name}", by, self.buckets)
        delete(spark, self.path)


def _micro(x: Column) -> Column:
    return F.round(F.log(1 + x) * 1e6).cast("long")


def _classes(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """(source, facet, tokens, ids): rows with the same tokens, and their smallest ids."""
    nth = F.row_number().over(Window.partitionBy("source", "facet", "tokens").orderBy(id_col))
    few = rows.withColumn("n", nth).where(F.col("n") <= most)
    return few.groupBy("source", "facet", "tokens").agg(F.sort_array(F.collect_list(id_col)).alias("ids")).withColumn("class", F.monotonically_increasing_id())


def _profiles(classes: DataFrame, weights: DataFrame, totals: DataFrame) -> DataFrame:
    """(class, source, facet, weight, known): the weight of all tokens, and those that the source
    has, heaviest first, each with the weight from it on."""
    words = classes.select("class", "source", "facet", F.explode("tokens").alias("token")).join(F.broadcast(totals), "source")  # a row per source
    each = words.join(weights, ["source", "token"], "left")
    known = F.sort_array(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "token", "idf"))))
    rows = each.groupBy("class", "source", "facet").agg(F.sum(F.coalesce("idf", "unseen")).alias("weight"), known.alias("k"))
    rest = lambda i: F.aggregate(F.slice("k", i + 1, F.size("k")), F.lit(0).cast("long"), lambda acc, x: acc + x["idf"])
    of = F.transform("k", lambda x, i: F.struct(F.xxhash64(x["token"]).alias("h"), x["idf"].alias("idf"), rest(i).alias("rest")))
    return rows.where(F.size("k") > 0).select("class", "source", "facet", "weight", of.alias("known"))


def _first_keys(profiles: DataFrame) -> DataFrame:
    """A row for each token of a class: key, place, weight so far, weight from the key's first
    token on, and whether that leads."""
    rows = profiles.select("class", "source", "facet", "weight", F.posexplode("known").alias("at", "t"))
    return rows.select(F.xxhash64("source", "facet", "t.h").alias("key"), "class", "weight", "at", F.col("t.idf").alias("got"), F.col("t.rest").alias("rest"), (2 * F.col("t.rest") >= F.col("weight")).alias("lead"))


def _longer_keys(keys: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each key with every later token of its class. Keys hold none of the tokens themselves: there are many to a class."""
    later = F.slice("known", F.col("at") + 2, F.size("known"))
    rows = keys.join(profiles.select("class", "known"), "class").select("key", "class", "weight", "at", "got", "rest", "lead", F.posexplode(later).alias("n", "t"))
    return rows.select(F.xxhash64("key", "t.h").alias("key"), "class", "weight", (F.col("at") + F.col("n") + 1).alias("at"), (F.col("got") + F.col("t.idf")).alias("got"), "rest", "lead")


def build_index(catalog: DataFrame, path: str | None = None, frequent: int | None = None) -> TitleIndex:
    """Writes the index of all works with a title."""
    spark = catalog.sparkSession
    frequent = FREQUENT if frequent is None else frequent
    path, buckets = path or shared_path(spark, "titles"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    write = lambda df, name: write_bucketed(df, f"{path}/{name}", _TABLES[name][1], buckets)
    works = keep(catalog.where("title IS NOT NULL").select("work_id", "source", F.sort_array(X.title_tokens(F.col("title"))).alias("tokens"), _work_facets().alias("facets")))
    total = works.groupBy("source").agg(F.count("*").alias("total"))
    write(total.select("source", _micro(F.col("total")).alias("unseen")), "totals")
    df = works.select("source", F.explode("tokens").alias("token")).groupBy("source", "token").agg(F.count("*").alias("df"))
    write(df.join(F.broadcast(total), "source").select("source", "token", "df", _micro(F.col("total") / F.col("df")).alias("idf")), "weights")  # a row per source
    index = TitleIndex(path, buckets, 0)
    classes = keep(_classes(works.select("work_id", "source", "tokens", F.explode("facets").alias("facet")), "work_id", PER_SOURCE))
    profiles = keep(_profiles(classes, index.table(spark, "weights"), index.table(spark, "totals")))
    write(profiles.join(classes.select("class", "ids"), "class").select("class", "source", "weight", F.transform("known", lambda x: x["h"]).alias("wk"), "ids"), "classes")

    depth, keys, levels = 0, keep(_first_keys(profiles)), []
    while True:
        often = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > frequent).select("key")
        hot = keep(keys.join(often, "key", "left_semi"))
        levels.append((keys, hot))
        if hot.isEmpty():
            break
        depth += 1
        keys = keep(_longer_keys(hot, profiles))
    single = [k.join(h.select("key").distinct(), "key", "left_anti").select("key", "class", "weight", "rest", "lead") for k, h in levels]
    write(_all(single), "keys")
    ids = classes.select("class", F.explode("ids").alias("work_id"))
    first = Window.partitionBy("key", "alone").orderBy("work_id")
    # the first five of all works that hold a key, and of those of whose title it is half
    held = _all([h.select("key", "class", F.explode(F.when(2 * F.col("got") >= F.col("weight"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("alone")) for _, h in levels])
    firsts = held.join(ids, "class").withColumn("n", F.row_number().over(first)).where(F.col("n") <= PER_SOURCE)
    write(firsts.select("key", "class", "alone").distinct(), "frequent")
    discard(works, classes, profiles, *(t for level in levels for t in level))
    index = TitleIndex(path, buckets, depth)
    spark.createDataFrame([(json.dumps(asdict(index)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/index")
    return index


def open_index(spark: SparkSession, path: str) -> TitleIndex:
    """An index that an earlier run has written."""
    return TitleIndex(**json.loads(spark.read.text(f"{path}/index").first()[0]) | {"path": path})


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _facet_of(source: Column, by_year: Column, by_author: Column, otherwise: Column) -> Column:
    named = lambda kind: [s for s, r in REGISTRY.items() if r.search_filter == kind]
    return F.when(source.isin(*named("year")), by_year).when(source.isin(*named("first_author")), by_author).otherwise(otherwise)


def _work_facets() -> Column:
    any_ = F.array(F.lit("*"))
    year = F.concat(F.array_compact(F.array(F.col("year").cast("string"))), any_)
    return _facet_of(F.col("source"), year, F.array_union(F.transform("authors", S.surname), any_), any_)


def _asked_facet() -> Column:
    any_, first = F.lit("*"), S.surname(F.get("authors", F.lit(0)))
    return _facet_of(F.col("source"), F.coalesce(F.col("year").cast("string"), any_), F.coalesce(first, any_), any_)


def search_index(refs: DataFrame, index: TitleIndex, sources: Column) -> DataFrame:
    """Hits (ref_id, work_id, source, via, rank) of references in the sources that each may ask."""
    spark = refs.sparkSession
    read = lambda name: index.table(spark, name)
    asked = refs.where("title IS NOT NULL").select("ref_id", F.sort_array(X.title_tokens(F.col("title"))).alias("tokens"), "year", "authors", F.explode(sources).alias("source"))
    asked = keep(asked.select("ref_id", "source", _asked_facet().alias("facet"), "tokens"))
    classes = keep(asked.select("source", "facet", "tokens").distinct().withColumn("class", F.monotonically_increasing_id()))
    profiles = keep(_profiles(classes, read("weights"), read("totals")))

    keys = keep(_first_keys(profiles))
    levels, hot = [keys], read("frequent").select("key").distinct()
    for _ in range(index.depth):
        levels.append(keep(_longer_keys(levels[-1].join(hot, "key", "left_semi"), profiles)))
    every = _all(levels).select("key", F.col("class").alias("ref_class"), F.col("weight").alias("rw"), "got", F.col("rest").alias("r_rest"), F.col("lead").alias("r_lead"))
    profile = profiles.select(F.col("class").alias("ref_class"), F.col("weight").alias("rw"), F.transform("known", lambda x: F.struct(x["h"].alias("h"), x["idf"].alias("idf"))).alias("rk"))
    near = 2 * F.least("rest", "r_rest") >= F.least("weight", "rw")  # what a pair can share from its key on
    shared = F.aggregate("rk", F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.array_contains("wk", x["h"]), x["idf"]).otherwise(F.lit(0).cast("long")))
    place = lambda last: F.row_number().over(Window.partitionBy("ref_class").orderBy(F.desc("shared"), last))
    slices = 1 + profiles.count() // PER_SLICE
    found = []
    for i in range(slices):
        ours, r = (t.where(F.pmod("ref_class", F.lit(slices)) == i) for t in (every, profile))
        led = ours.where("r_lead").join(read("keys"), "key").where(near).select("ref_class", "class")
        led_by_works = ours.where("NOT r_lead").join(read("keys").where("lead"), "key").where(near).select("ref_class", "class")
        alike = ours.join(read("frequent"), "key").where(F.col("alone") | (2 * F.col("got") >= F.col("rw"))).select("ref_class", "class")
        pairs = _all([led, led_by_works, alike]).repartition(index.buckets, "class").distinct()  # dealt as the index's classes are
        met = pairs.join(read("classes").select("class", "weight", "wk", F.get("ids", F.lit(0)).alias("first")), "class").join(r, "ref_class")
        scored = met.select("ref_class", "class", "first", shared.alias("shared"), F.least("rw", "weight").alias("least")).where(2 * F.col("shared") >= F.col("least"))
        # a class behind five others, by its first work, has none among the best five: only those are told their works
        few = scored.withColumn("n", place("first")).where(F.col("n") <= PER_SOURCE).select("ref_class", "class", "shared")
        works = few.join(read("classes").select("class", "source", "ids"), "class").select("ref_class", "source", F.explode("ids").alias("work_id"), "shared")
        found.append(keep(works.withColumn("rank", place("work_id")).where(F.col("rank") <= PER_SOURCE)))
    member = asked.join(classes, ["source", "facet", "tokens"]).select("ref_id", F.col("class").alias("ref_class"))
    hits = keep(member.join(_all(found), "ref_class").select("ref_id", "work_id", "source", F.lit("title").alias("via"), "rank"))
    discard(asked, classes, profiles, *levels, *found)
    return hits
