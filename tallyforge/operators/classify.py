"""Which carrier and kind a document is of (J15-J21, J37, W6): rule tables of bounded size against file names and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.automaton import occurrences


def by_filename(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files: doc_id, file_name, and any others. patterns: carrier, doc_type, pattern, confidence, position; rules, so their number is
    bounded: they become one expression, and files are neither joined nor grouped.

    The surest pattern wins, of equals the first. Without one, the name alone may tell the kind (F17)."""
    rules = [F.when(F.col("file_name").rlike(r["pattern"]), F.struct(F.lit(r["confidence"]).cast("double").alias("confidence"), F.lit(-r["position"]).alias("at"), F.lit(r["carrier"]).cast("string").alias("carrier"), F.lit(r["doc_type"]).cast("string").alias("doc_type"))) for r in patterns.collect()]
    best = F.array_max(F.filter(F.array(*rules), lambda h: h.isNotNull())) if rules else F.lit(None).cast("struct<confidence:double,at:int,carrier:string,doc_type:string>")
    sure = F.when(best["confidence"] > 0.85, "high").when(best["confidence"].isNotNull(), "medium").otherwise("low")
    return files.select(*files.columns, best["carrier"].alias("carrier"), F.coalesce(best["doc_type"], X.document_type(F.col("file_name"))).alias("doc_type"), sure.alias("level"))


def by_content(files: DataFrame, signals: list[tuple[str, list[str], list[tuple[str, str]]]]) -> DataFrame:
    """Files: text. signals: (carrier, texts of which one must occur, [(kind, marker)]), carriers sorted by name: the first that has
    a signal wins; its first marker that occurs tells the kind."""
    low = F.lower("text")
    who, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for carrier, required, markers in sorted(signals, reverse=True):
        has = X.any_of([low.contains(s.lower()) for s in required])
        own = F.lit(None).cast("string")
        for doc_type, marker in reversed(markers):
            own = F.when(low.contains(marker.lower()), doc_type).otherwise(own)
        who, kind = F.when(has, carrier).otherwise(who), F.when(has, own).otherwise(kind)
    return files.withColumns({"carrier": who, "doc_type": kind})


def deep_scan(files: DataFrame, registry: list[tuple[str, str, list[str], list[str]]], least: int = 5, lead: float = 2.0) -> DataFrame:
    """Points by carrier: 5 for an alias (of four letters at least, as words), 10 for the name, 2 for each account number; the best wins with
    enough points and twice the next one's; of equals the first. registry: (key, name, aliases, account patterns).

    All names and aliases are looked for in one pass (occurrences); a pattern of accounts that several carriers have is searched once. Only
    carriers with a hit are compared."""
    patterns = [(2 * i, name, False) for i, (_, name, _, _) in enumerate(registry)] + [(2 * i + 1, a, True) for i, (_, _, aliases, _) in enumerate(registry) for a in aliases if len(a) >= 4]
    owners: dict[str, list[int]] = {}
    for i, (_, _, _, accounts) in enumerate(registry):
        for p in accounts:
            owners.setdefault(p, []).append(i)
    text, kind = F.coalesce("text", F.lit("")), "array<struct<at:int,points:int>>"
    hits = F.transform("_found", lambda h: F.struct((h["i"] / 2).cast("int").alias("at"), F.when(h["i"] % 2 == 0, 10).otherwise(5).alias("points"))).cast(kind)
    numbers = [F.when(F.size(F.regexp_extract_all(text, F.lit(p), 0)) > 0, F.array(*(F.struct(F.lit(i).alias("at"), (F.size(F.regexp_extract_all(text, F.lit(p), 0)) * 2).alias("points")) for i in own))).otherwise(F.array().cast(kind)).cast(kind) for p, own in owners.items()]
    found = files.withColumn("_found", occurrences(files.sparkSession, text, patterns)).withColumn("_hits", F.concat(hits, *numbers))
    total = lambda at: F.aggregate(F.filter("_hits", lambda h: h["at"] == at), F.lit(0), lambda s, h: s + h["points"])
    ranked = F.reverse(F.array_sort(F.transform(F.array_distinct(F.transform("_hits", lambda h: h["at"])), lambda at: F.struct(total(at).alias("points"), (-at).alias("at")))))
    top, second = F.try_element_at("_ranked", F.lit(1)), F.coalesce(F.try_element_at("_ranked", F.lit(2))["points"], F.lit(0))
    points = F.coalesce(top["points"], F.lit(0))
    key = F.try_element_at(F.array(*(F.lit(r[0]) for r in registry)), 1 - top["at"]) if registry else F.lit(None).cast("string")
    return found.withColumn("_ranked", ranked).withColumns({"carrier": F.when((points >= least) & (points >= lead * second), key), "points": points, "runner_up": second}).drop("_found", "_hits", "_ranked")


def signature(text: Column, required: list[str], any_of: list[str]) -> Column:
    """All required patterns and, if there are any, one of the others; in any case."""
    out = F.lit(True)
    for p in required:
        out = out & text.rlike(f"(?i){p}")
    return out & X.any_of([text.rlike(f"(?i){p}") for p in any_of]) if any_of else out


def agree(df: DataFrame, policy: str = "check") -> DataFrame:
    """Columns a_carrier, a_level, b_carrier, b_level of the two stages. 'check': agreement is sure, disagreement is left to the next
    stage; 'prefer_content': the second stage leads, without a check (Q-23)."""
    a, b = F.col("a_carrier"), F.col("b_carrier")
    if policy == "prefer_content":
        return df.withColumns({"carrier": F.coalesce(b, a), "level": F.when(b.isNotNull(), F.col("b_level")).otherwise(F.col("a_level")), "open": F.coalesce(b, a).isNull()})
    carrier = F.when(a == b, a).when(a.isNull(), b).when(b.isNull(), a)
    level = F.when(a == b, "high").when(carrier.isNotNull(), F.coalesce(F.when(a.isNotNull(), F.col("a_level")), F.col("b_level")))
    return df.withColumns({"carrier": carrier, "level": level, "open": carrier.isNull()})


def reclassify(rows: DataFrame, files: DataFrame, share: float = 0.6) -> DataFrame:
    """Files whose rows name another carrier in more than the share of those that name one. rows: doc_id, carrier_name."""
    named = rows.filter(X.truthy(F.trim("carrier_name"))).groupBy("doc_id", X.carrier(F.col("carrier_name")).alias("voted")).agg(F.count("*").alias("n"))
    top = named.groupBy("doc_id").agg(F.max_by("voted", F.struct("n", "voted")).alias("voted"), (F.max("n") / F.sum("n")).alias("share"))
    out = files.join(top, "doc_id", "left")
    moves = (F.col("share") > share) & (F.col("voted") != X.carrier(F.col("carrier")))
    return out.withColumns({"reclassified": F.coalesce(moves, F.lit(False)), "carrier": F.when(moves, F.col("voted")).otherwise(F.col("carrier"))}).drop("voted")


def _parts(c: Column, lengths: list[int]) -> Column:
    """All parts of a text that have one of the lengths."""
    of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(of, lengths)))) if lengths else F.array().cast("array<string>")


def match_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Names: name. registry: key, display, aliases array, position. Exact by letters and digits; else the longest alias (three letters at least)
    that the name holds; else the first alias that holds the name. Of equals the first carrier.

    Distinct names are matched, not rows, and by equality: parts of a name as long as some alias meet aliases, parts of aliases meet names.
    No side is broadcast, and no name is compared with every alias."""
    alias = registry.select(F.struct("position", "key", "display").alias("c"), F.explode(F.array_union(F.array("display"), F.coalesce("aliases", F.array()))).alias("alias")).select("c", X.name_key(F.col("alias")).alias("a")).filter("a != ''")
    alias = alias.groupBy("a").agg(F.min("c").alias("c"))
    asked = names.select("name").distinct().withColumn("n", X.name_key(F.col("name"))).filter("n != ''")
    lengths = sorted(r["n"] for r in alias.select(F.length("a").alias("n")).filter("n >= 3").distinct().collect())
    exact = asked.join(alias, F.col("a") == F.col("n")).select("name", F.lit(1).alias("turn"), F.lit(0).alias("size"), "c")
    within = asked.select("name", F.explode(_parts(F.col("n"), lengths)).alias("a")).join(alias, "a").select("name", F.lit(2).alias("turn"), (-F.length("a")).alias("size"), "c")
    every = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("a") - 2), lambda i: F.transform(F.sequence(F.lit(3), F.length("a") - i + 1), lambda n: F.substr("a", i, n)))))
    parts = alias.filter(F.length("a") >= 3).select("c", F.explode(every).alias("n")).groupBy("n").agg(F.min("c").alias("c"))
    around = asked.join(parts, "n").select("name", F.lit(3).alias("turn"), F.lit(0).alias("size"), "c")
    best = exact.unionByName(within).unionByName(around).groupBy("name").agg(F.min_by("c", F.struct("turn", "size", "c")).alias("m"))
    return names.join(best, "name", "left").select(*names.columns, F.coalesce("m.display", F.trim("name")).alias("canonical"), F.col("m").isNotNull().alias("registered"), F.col("m.key").alias("carrier_key"))


def display_names(rows: DataFrame, registry: DataFrame, column: str = "carrier") -> DataFrame:
    """A slug's name; an unknown slug without its underscores."""
    names = F.broadcast(registry.select(F.col("key").alias(column), F.col("display").alias("_d")))
    return rows.join(names, column, "left").withColumn("carrier_display", F.coalesce("_d", F.trim(F.replace(F.col(column), F.lit("_"), F.lit(" "))))).drop("_d")


def tallies(files: DataFrame) -> DataFrame:
    """Counts by carrier, kind and level."""
    return files.groupBy("carrier", "doc_type", "level").agg(F.count("*").alias("files"))


def top_two(scores: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """The best of each group and the next."""
    w = Window.partitionBy(group).orderBy(F.desc(score), name)
    return scores.withColumn("at", F.row_number().over(w)).filter("at <= 2").groupBy(group).agg(F.max(F.when(F.col("at") == 1, F.col(name))).alias("best"), F.max(F.when(F.col("at") == 1, F.col(score))).alias("best_score"), F.max(F.when(F.col("at") == 2, F.col(score))).alias("next_score"))
