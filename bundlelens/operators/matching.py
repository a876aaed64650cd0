"""Matching members with names: one-to-one assignment, likeness within a group, identification in rounds.

All of it is joins and aggregates over edge tables. Rounds are written to the checkpoint folder; only counts come to the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.operators.graphs import Rounds, written


def greedy(edges: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(left, right, score, round): the edges (left, right, score) that a scan by falling score, then left, then right
    takes when it skips those that have an end in use. taken: (right) that are in use from the start.

    In each round an edge is taken if no open edge of either of its ends comes before it; then its ends are struck out.
    The first open edge of all always is one, and an edge taken so is taken by the scan too, so the rounds end with the
    scan's result. An end with very many edges costs each task one row in each aggregate. Edges with a null are none; of
    equal edges the best score counts.
    """
    open_ = edges.where("left IS NOT NULL AND right IS NOT NULL AND score IS NOT NULL").groupBy("left", "right").agg(F.max("score").alias("score"))
    if taken is not None:
        open_ = open_.join(taken.select("right").distinct(), "right", "left_anti").select("left", "right", "score")
    open_, found, n = written(open_), None, 1
    while True:
        of_left = open_.groupBy("left").agg(F.min(F.struct((-F.col("score")).alias("below"), "right")).alias("b")).select("left", F.col("b.right").alias("right"))
        of_right = open_.groupBy(F.col("right").alias("_right")).agg(F.min(F.struct((-F.col("score")).alias("below"), "left")).alias("b")).select("_right", F.col("b.left").alias("_left"), (-F.col("b.below")).alias("score"))
        both = of_left.join(of_right, (F.col("right") == F.col("_right")) & (F.col("left") == F.col("_left")))
        now = written(both.select("left", "right", "score", F.lit(n).alias("round")))
        if now.isEmpty():
            return now if found is None else found.rows()
        if found is None:
            found = Rounds(now)
        else:
            found.add(now)
        open_ = written(open_.join(now.select("left"), "left", "left_anti").join(now.select("right"), "right", "left_anti").select("left", "right", "score"))
        n += 1


def probes(features: DataFrame, by: list[str], frequency: DataFrame, share: float) -> DataFrame:
    """The rows of `features` (by.., feature, _n) one of which any set has that shares that part of a set's _n features:
    the rarest by `frequency` (.., feature, _df), those without a frequency first."""
    on = [c for c in frequency.columns if c != "_df"]
    ranked = features.join(frequency, on, "left").withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce("_df", F.lit(0)), "feature")))
    return ranked.where(F.col("_place") <= F.col("_n") - F.ceil(F.lit(share) * F.col("_n") - 1e-9) + 1).drop("_place", "_df")


def feature_sets(features: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """(by.., _features, _n, more..): the distinct features of the rows (by.., feature), and how many; one shuffle."""
    rows = features.groupBy(*by).agg(F.collect_set(F.struct("feature")).alias("_features"), *more)
    return rows.withColumn("_n", F.size("_features")).withColumn("_features", F.col("_features.feature"))


def _scores(own: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """(group, member, candidate, score) of `likeness`, of sets (group, member, _features, _n) and (group, candidate,
    _features, _n). Sets go to their pairs as they are; features are rows only to bring pairs."""
    held = other.select("group", "candidate", F.explode("_features").alias("feature"))
    frequency = held.groupBy("group", "feature").agg(F.count("*").alias("_df"))
    asked = probes(own.select("group", "member", "_n", F.explode("_features").alias("feature")), ["group", "member"], frequency, least).select("group", "member", "feature")
    pairs = asked.join(held, ["group", "feature"]).select("group", "member", "candidate").distinct()
    mine, theirs = own.withColumnRenamed("_n", "_a"), other.withColumnRenamed("_n", "_b").withColumnRenamed("_features", "_others")
    both = pairs.join(mine, ["group", "member"]).join(theirs, ["group", "candidate"])
    shared = both.withColumn("_s", F.size(F.array_intersect(F.filter("_features", lambda x: x.isNotNull()), "_others")))
    return shared.withColumn("score", F.col("_s") / (F.col("_a") + F.col("_b") - F.col("_s"))).where(F.col("score") >= least - 1e-9).select("group", "member", "candidate", "score")


def likeness(mine: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """(group, member, candidate, score): the Jaccard coefficients, of `least` or more, of the feature sets of members
    (group, member, feature) and candidates (group, candidate, feature) of one group.

    A pair of such a coefficient shares that part of the member's features at least, so candidates are brought by the
    member's rarest features alone, and only these pairs are counted in full.
    """
    return _scores(written(feature_sets(mine, ["group", "member"])), written(feature_sets(theirs, ["group", "candidate"])), least)


def classes(rows: DataFrame, key: str, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((group, class, key), (group, class, _features, _n)): the sets (group, key, feature) that share a feature with
    `other` (group, feature), by classes of as many features and the same ones of those that `other` has. All sets of a
    class have the same coefficients with all of `other`, so classes are compared once, however many copies they have."""
    known = other.select("group", "feature").distinct().withColumn("_known", F.lit(True))
    sets = rows.select("group", key, "feature").distinct().join(known, ["group", "feature"], "left")
    sets = sets.groupBy("group", key).agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("_known"), F.col("feature")))).alias("_features")).where(F.size("_features") > 0)
    sets = written(sets.withColumn("class", F.sha2(F.to_json(F.struct("_n", "_features")), 256)))
    one = sets.groupBy("group", "class").agg(F.min(F.struct("_n", "_features")).alias("_s"))
    return sets.select("group", "class", key), one.select("group", "class", F.col("_s._features").alias("_features"), F.col("_s._n").alias("_n"))


def clear_candidates(mine: DataFrame, theirs: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(member, candidate, score, margin): of members (group, member, feature) the candidate (group, candidate, feature) of
    their group that is clearly most like them, as `clear_best` says of `likeness`. Members and candidates are compared by
    classes, so n copies of a set cost n rows and not their square; of a class of several candidates none is clear."""
    members, own = classes(mine, "member", theirs)
    candidates, other = classes(theirs, "candidate", mine)
    scores = _scores(written(own.withColumnRenamed("class", "member")), written(other.withColumnRenamed("class", "candidate")), threshold - margin).where("score > 0")
    alone = candidates.groupBy("group", F.col("class").alias("candidate")).agg(F.min("candidate").alias("_one"), F.count("*").alias("_copies"))
    best = clear_best(scores, ["group", "member"], "candidate", threshold, margin).join(alone, ["group", "candidate"]).where("_copies = 1")
    return members.join(best.withColumnRenamed("member", "class"), ["group", "class"]).select("member", F.col("_one").alias("candidate"), "score", "margin")


def clear_best(scores: DataFrame, by: list[str], name: str, threshold: float, margin: float, own_name: Column | None = None) -> DataFrame:
    """(by.., name, score, margin): the name with the best score, if that reaches the threshold and leads the next lower
    score by the margin. Several names with the best score settle nothing, but for one of them alone that `own_name`
    (a condition) speaks for."""
    group = Window.partitionBy(*by)
    ranked = scores.withColumn("_top", F.max("score").over(group)).withColumn("_own", F.coalesce(own_name, F.lit(False)) if own_name is not None else F.lit(False))
    best = F.col("score") == F.col("_top")
    ranked = ranked.withColumn("_next", F.coalesce(F.max(F.when(~best, F.col("score"))).over(group), F.lit(0.0)))
    ranked = ranked.withColumn("_ties", F.count_if(best).over(group)).withColumn("_named", F.count_if(best & F.col("_own")).over(group))
    sure = (F.col("_ties") == 1) | ((F.col("_named") == 1) & F.col("_own"))
    lead = F.col("_top") - F.col("_next")
    return ranked.where(best & sure & (F.col("_top") >= threshold - 1e-9) & (lead >= margin - 1e-9)).select(*by, name, "score", lead.alias("margin"))


def match_members(mine: DataFrame, theirs: DataFrame, threshold: float = 0.8, margin: float = 0.1, least: int = 4) -> DataFrame:
    """(group, member, name, score, margin): what the members (group, member, feature) of a group are, by the named
    candidates (group, candidate, name, feature) of the same group. Of a name's candidates the best counts, a member's
    own name is not looked for. Members of less than `least` features take part only if one is `A:call`; of names with
    equal scores that counts which the member has as a string (`S:name`)."""
    hole = F.max(F.col("feature").isNull().cast("int")).alias("_hole")
    own = feature_sets(mine, ["group", "member"], F.max(F.col("feature") == "A:call").alias("_call"), hole)
    own = written(own.where((F.col("_n") - F.col("_hole") >= least) | F.col("_call")).drop("_call", "_hole"))
    other = written(feature_sets(theirs, ["group", "candidate"], F.collect_set(F.col("name")).alias("_names")))
    scores = _scores(own, other.drop("_names"), threshold - margin)
    named = scores.join(other.select("group", "candidate", F.explode("_names").alias("name")), ["group", "candidate"]).where("name <> member")
    best = named.groupBy("group", "member", "name").agg(F.max("score").alias("score"))
    said = own.select("group", "member", F.explode(F.filter("_features", lambda x: x.startswith("S:"))).alias("_string"))
    said = said.select("group", "member", F.expr("substring(_string, 3)").alias("name"), F.lit(True).alias("_said"))
    return clear_best(best.join(said, ["group", "member", "name"], "left"), ["group", "member"], "name", threshold, margin, F.col("_said"))


def identify_in_rounds(features: DataFrame, calls: DataFrame, library: DataFrame, library_calls: DataFrame, rounds: int = 4, threshold: float = 0.8, margin: float = 0.1) -> tuple[DataFrame, list[int]]:
    """((module, function, name, score, round), functions scored in each round).

    features: (module, function, feature); calls: (module, function, callee) within a module; library: (name, feature);
    library_calls: (name, callee). A function that calls another whose name is known has the feature `C:` and that name,
    and so does a library function for each name it calls. In each round functions without a name take the library
    function that is clearly most like them; of a module's functions that want one name the best, then the first, gets
    it, and a name is given once in a module. What a round names is a feature in the next: only the callers of what was
    named are scored again, since nothing has changed for the others. Rounds end when none is named.
    """
    theirs = library.select(F.lit(0).alias("group"), F.col("name").alias("candidate"), "feature").unionByName(library_calls.select(F.lit(0).alias("group"), F.col("name").alias("candidate"), F.concat(F.lit("C:"), "callee").alias("feature")))
    theirs, calls = written(theirs.distinct()), written(calls.select("module", "function", "callee").distinct())
    own = written(features.select("module", "function", "feature").distinct())
    dirty, named, work = written(own.select("module", "function").distinct()), None, []
    for n in range(1, rounds + 1):
        work.append(dirty.count())
        if not work[-1]:
            work.pop()
            break
        asked = own.join(dirty, ["module", "function"], "left_semi").select(F.lit(0).alias("group"), F.struct("module", "function").alias("member"), "feature")
        best = clear_candidates(asked, theirs, threshold, margin)
        wanted = best.select("member.module", "member.function", F.col("candidate").alias("name"), "score")
        if named is not None:
            wanted = wanted.join(named.rows().select("module", "name"), ["module", "name"], "left_anti")
        won = wanted.groupBy("module", "name").agg(F.min(F.struct((-F.col("score")).alias("_below"), "function")).alias("b"))
        fresh = written(won.select("module", F.col("b.function").alias("function"), "name", (-F.col("b._below")).alias("score"), F.lit(n).alias("round")))
        if named is None:
            named = Rounds(fresh)
        elif fresh.isEmpty():
            break
        else:
            named.add(fresh)
        learned = calls.join(fresh.select("module", F.col("function").alias("callee"), "name"), ["module", "callee"]).select("module", "function", F.concat(F.lit("C:"), "name").alias("feature"))
        learned = learned.join(named.rows().select("module", "function"), ["module", "function"], "left_anti").distinct()
        own = written(own.unionByName(learned).distinct())
        dirty = written(learned.select("module", "function").distinct())
    if named is None:
        return own.limit(0).select("module", "function", F.lit("").alias("name"), F.lit(0.0).alias("score"), F.lit(0).alias("round")), work
    return named.rows(), work
