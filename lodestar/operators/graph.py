"""Graphs as nodes and edges: lookup, one hop, impact, reference resolution and expansion of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import settle

SEEDS, EXTRA, DEPTH = 3, 4, 3
#: Characters of names by how much they are used; any fixed order gives the same results.
BY_USE = "etaoinsrl_dcupmhgfybvwkxqzj0123456789"

# Names that too many types have for one definition to be meant.
COMMON_NAMES = """
get set send close update items keys values append pop copy read write join split format encode decode strip
lower upper startswith endswith replace add remove clear extend insert open run setdefault sort index count
__init__ __call__ __enter__ __exit__ __iter__ __getitem__ __setitem__ __contains__ __len__ __repr__ __eq__
info debug warning error exception commit flush seek tell readline lstrip rstrip
""".split()


def _symbol(c: Column) -> Column:
    s = F.regexp_replace(T.strip(c), "^`+|`+$", "")
    return F.regexp_replace(s, "\\(\\)$", "")


def find(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(qid, id, tier) for ``symbols`` (qid, symbol): the exact qualified names, else suffixes and short names, else those without case.

    An equality join on the lower-case short name, which all three tiers share.
    """
    short = lambda c: F.lower(F.element_at(F.split(c, "\\.", -1), -1))
    asked = symbols.select("qid", _symbol(F.col("symbol")).alias("s"))
    asked = asked.withColumn("short", short(F.col("s")))
    known = nodes.filter("kind <> 'module'").select("id", "name", "qual", short(F.col("qual")).alias("short"))
    s, q = F.col("s"), F.col("qual")
    ends = lambda whole, end: whole.endswith(F.concat(F.lit("."), end))
    tier = F.when(q == s, 0).when(ends(q, s) | (F.col("name") == s), 1).when((F.lower(q) == F.lower(s)) | ends(F.lower(q), F.lower(s)) | (F.lower("name") == F.lower(s)), 2)
    hits = asked.join(known, "short").withColumn("tier", tier).filter("tier is not null")
    best = Window.partitionBy("qid")
    return hits.withColumn("best", F.min("tier").over(best)).filter("tier = best").select("qid", "id", "tier")


def _rarest(name: Column) -> Column:
    """The characters of a name that :func:`similar` blocks by: the k-th of its kind counts as another, later ones are rarer."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    place = lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))
    ordered = F.sort_array(F.transform(chars, lambda c, i: F.struct((-place(c, i)).alias("k"), (-F.position(c, F.lit(BY_USE))).alias("use"), c.alias("c"))))
    n = F.length(name)
    return F.transform(F.slice(ordered, F.lit(1), n - F.ceil(3 * n / 7).cast("int") + 1), lambda t: F.concat(t["c"], t["k"].cast("string")))


def similar(nodes: DataFrame, symbols: DataFrame, n: int = 5) -> DataFrame:
    """(qid, pos, name): known names that look like a symbol, by difflib's ratio, then those that contain it or lie in it.

    A ratio of 0.6 between lengths a and b needs 0.3 (a + b) common characters, so b is 3 a / 7 at least and 3 a / 7 characters are
    common. Names and symbols therefore meet by one of their rarest characters: with the first a - 3 a / 7 + 1 of each in one order of
    rarity, no pair is missed. Pairs are bounded again by the counts of their characters before the ratio itself is worked out.
    Containment meets by a run of three characters. Different symbols are compared once, however often they are asked for, and
    neither side is collected.
    """
    import difflib

    import pandas as pd

    low = F.lower(F.element_at(F.split(_symbol(F.col("symbol")), "\\.", -1), -1))
    asked = symbols.select("qid", low.alias("s")).filter("s <> ''")
    names = nodes.filter("kind <> 'module'").groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name")).withColumn("size", F.length("low"))
    wanted = asked.select("s").distinct().withColumn("size", F.length("s"))
    close = F.col("size").between(3 * F.col("_size") / 7, 7 * F.col("_size") / 3)
    alike = wanted.select("s", F.col("size").alias("_size"), F.explode(_rarest(F.col("s"))).alias("c")).join(names.select("low", "name", "size", F.explode(_rarest(F.col("low"))).alias("c")), "c")
    alike = alike.filter(close).select("s", "low", "name").distinct()
    # what contains a symbol or lies in it shares a run of characters with it; names of two characters or less have none
    grams = lambda c: F.explode(F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array(F.lit(""))))
    first = wanted.filter("size >= 4").select("s", F.substring("s", 1, 3).alias("g")).join(names.select("low", "name", grams(F.col("low")).alias("g")).distinct(), "g").filter(F.contains("low", "s"))
    inner = names.filter("size > 0").withColumn("g", F.when(F.col("size") >= 3, F.substring("low", 1, 3)).otherwise(F.lit("")))
    both = wanted.filter("size >= 4").select("s", grams(F.col("s")).alias("g")).unionByName(wanted.filter("size >= 4").select("s", F.lit("").alias("g"))).distinct()
    inside = both.join(inner, "g").filter(F.contains("s", "low"))
    held = first.select("s", "low", "name").unionByName(inside.select("s", "low", "name")).distinct().withColumn("kind", F.lit(1))
    pairs = alike.withColumn("kind", F.lit(0)).unionByName(held)

    def run(frames):
        match = difflib.SequenceMatcher()
        for frame in frames:
            rows = []
            for s, known, name, kind in frame[["s", "low", "name", "kind"]].itertuples(index=False):
                match.set_seqs(known, s)
                near = match.real_quick_ratio() >= 0.6 and match.quick_ratio() >= 0.6 and match.ratio() >= 0.6
                if kind == 0 and near:
                    rows.append((s, name, known, 0, -match.ratio()))
                elif kind == 1 and not near:
                    rows.append((s, name, known, 1, 0.0))
            yield pd.DataFrame(rows, columns=["s", "name", "low", "kind", "order"])

    found = pairs.mapInPandas(run, "s string, name string, low string, kind int, order double")
    # equal ratios: difflib names the larger word first; containment keeps the order of the sorted names
    by = Window.partitionBy("s").orderBy("kind", "order", F.when(F.col("kind") == 0, F.col("low")).desc_nulls_last(), "name")
    best = found.withColumn("pos", F.row_number().over(by)).filter(F.col("pos") <= n)
    return asked.join(best, "s").select("qid", "pos", "name")


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges into ``targets`` (qid, id)."""
    return targets.join(edges, targets.id == edges.dst).select("qid", "src", "dst", "kind", "line")


def callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges out of ``sources`` (qid, id)."""
    return sources.join(edges, sources.id == edges.src).select("qid", "src", "dst", "kind", "line")


def impact(edges: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(qid, id, hop): everything that reaches ``starts`` (qid, id) over at most ``depth`` edges, with its distance.

    One join a hop, from the nodes that the hop before added; the start itself is left out. Each hop is written before the next, so that
    no hop plans those before it again, and the walk ends where nothing is added.
    """
    back = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).distinct()
    seen = front = settle(starts.select("qid", "id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, depth + 1):
        new = front.join(back, front.id == back._dst).select("qid", F.col("_src").alias("id")).distinct()
        front = settle(new.join(seen.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def impact_edges(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """:func:`impact` with the edge that reaches each node first (qid, id, hop, via, kind, line): callers by path and line."""
    back = edges.join(nodes.select(F.col("id").alias("src"), F.col("path").alias("_path")), "src").select("src", "dst", F.col("kind").alias("_kind"), F.col("line").alias("_line"), "_path")
    none = F.lit(None)
    seen = starts.select("qid", "id").distinct().select("qid", "id", F.lit(0).alias("hop"), none.cast("long").alias("via"), none.cast("string").alias("kind"), none.cast("int").alias("line"), F.array(F.lit(0)).alias("turn"))
    front = seen
    for hop in range(1, depth + 1):
        met = front.select("qid", F.col("id").alias("_at"), F.col("turn").alias("_turn")).join(back, F.col("_at") == back.dst)
        # breadth first: by the turn of the node that is left, then path and line of the caller
        order = Window.partitionBy("qid", "src").orderBy("_turn", "_path", "_line", "_kind")
        met = met.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
        turn = Window.partitionBy("qid", "_at").orderBy("_path", "_line", "src")
        met = met.withColumn("_k", F.row_number().over(turn))
        new = met.select("qid", F.col("src").alias("id"), F.lit(hop).alias("hop"), F.col("_at").alias("via"), F.col("_kind").alias("kind"), F.col("_line").cast("int").alias("line"), F.concat("_turn", F.array("_k")).alias("turn"))
        front = settle(new.join(seen.select("qid", "id"), ["qid", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hop > 0").drop("turn")


def affected(impacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, n_nodes, n_files) of what :func:`impact` found."""
    return impacts.join(nodes.select("id", "path"), "id").groupBy("qid").agg(F.count("*").alias("n_nodes"), F.countDistinct("path").alias("n_files"))


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind): the one with the smallest line."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "kind", "line")]
    first = edges.groupBy("src", "dst", "kind").agg(F.min(F.struct("line", *rest)).alias("e"))
    return first.select("src", "dst", "kind", "e.*")


def in_degrees(edges: DataFrame) -> DataFrame:
    """(dst, n): how many edges end at a node."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"))


def suggestions(nodes: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """(pos, qual, n): the public functions and methods with most callers; earlier nodes first among equals."""
    public = nodes.filter(F.col("kind").isin("function", "method") & ~F.col("name").startswith("_"))
    ranked = public.join(in_degrees(edges), nodes.id == F.col("dst")).orderBy(F.desc("n"), "id").limit(most)
    return ranked.select(F.row_number().over(Window.orderBy(F.desc("n"), "id")).alias("pos"), "qual", "n")


def ancestry(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """(qual, pos, base): names of all base classes of each class, nearest first.

    bases: (qual, n, base), the n-th base that a class names. classes: (qual, name). A base is followed to every class that has
    it as qualified or short name; one join a level, each base once, until nothing is added. Each level is written before the
    next, so that a deep hierarchy does not plan all levels at once; cycles end by themselves.
    """
    names = classes.select(F.explode(F.array_distinct(F.array("qual", "name"))).alias("base"), F.col("qual").alias("of"))
    further = bases.select(F.col("qual").alias("of"), F.col("n").alias("_n"), F.col("base").alias("_b"))
    step = settle(names.join(further, "of").select("base", "_n", "_b"))
    seen = front = settle(bases.select("qual", "base", F.array("n").alias("turn")).groupBy("qual", "base").agg(F.min("turn").alias("turn")))
    while not front.isEmpty():
        new = front.join(step, "base").select("qual", F.col("_b").alias("base"), F.concat("turn", F.array("_n")).alias("turn"))
        front = settle(new.groupBy("qual", "base").agg(F.min("turn").alias("turn")).join(seen.select("qual", "base"), ["qual", "base"], "left_anti"))
        seen = settle(seen.unionByName(front))
    order = Window.partitionBy("qual").orderBy(F.size("turn"), "turn", "base")
    return seen.withColumn("pos", F.row_number().over(order)).select("qual", "pos", "base")


def _suffixes(name: Column) -> Column:
    """a.b.c, b.c and c."""
    return T.let(F.split(name, "\\.", -1), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def resolve(nodes: DataFrame, refs: DataFrame, bases: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, kind, line, how) of the references that mean exactly one definition, and their counts.

    nodes: id, name, qual, path, kind, cls. refs: ref, owner (a node id), name, receiver, kind, line. bases: (qual, n, base).
    imports: (path, name). The first rule that fits any definition decides, and the edge stays if it fits one only. ``self``,
    ``cls`` and ``super(`` look in the owner's class, then its ancestors, nearest first; a bare name means the file's own
    definitions, else what the file imports, else the only definition that is no method and no common name; a receiver means a
    class of that name, else the only definition.

    Each rule is a table with one row a key: how many definitions have the key, and one of them. References meet these tables
    by equality, one row each, so a name with many definitions and many references makes no pairs.
    """
    defs = nodes.filter("kind <> 'module'").select(F.col("id").alias("dst"), "name", "path", "kind", F.coalesce("cls", F.lit("")).alias("cls"))
    method, inside = F.col("kind") == "method", defs.filter("cls <> ''")

    def rule(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.min("dst").alias(f"d_{name}"))

    by_name = defs.groupBy("name").agg(F.count("*").alias("n_only"), F.min("dst").alias("d_only"), F.count_if(~method).alias("n_top"), F.min(F.when(~method, F.col("dst"))).alias("d_top"))
    own = rule(inside.filter(method).withColumnRenamed("cls", "o_cls"), "self", "name", "o_cls")
    local = rule(defs.filter(~method).withColumnRenamed("path", "o_path"), "local", "name", "o_path")
    ending = inside.select("dst", "name", "kind", F.explode(_suffixes(F.col("cls"))).alias("end"))
    of_class = rule(ending.withColumnRenamed("end", "receiver"), "class", "name", "receiver")
    inherited = rule(ending.filter(method).withColumnRenamed("end", "base"), "base", "name", "base")
    owners = nodes.select(F.col("id").alias("owner"), F.col("path").alias("o_path"), F.when(F.col("kind") == "class", F.col("qual")).otherwise(F.coalesce("cls", F.lit(""))).alias("o_cls"))
    known = imports.select(F.col("path").alias("o_path"), "name").distinct().withColumn("imported", F.lit(True))
    asked = refs.join(owners, "owner")
    recv = F.col("receiver")
    climbs = F.coalesce(recv.isin("self", "cls") | recv.startswith("super("), F.lit(False))
    above = ancestry(bases, nodes.filter("kind = 'class'").select("qual", "name")).withColumnRenamed("qual", "o_cls")
    up = asked.filter(climbs & (F.col("o_cls") != "")).select("ref", "name", "o_cls").join(above, "o_cls").join(inherited, ["name", "base"])
    up = up.groupBy("ref").agg(F.min(F.struct("pos", "n_base", "d_base")).alias("u")).select("ref", "u.n_base", "u.d_base")
    met = asked.join(by_name, "name", "left").join(own, ["name", "o_cls"], "left").join(local, ["name", "o_path"], "left")
    met = met.join(of_class, ["name", "receiver"], "left").join(known, ["name", "o_path"], "left").join(up, "ref", "left")
    rare, bare, imported = ~F.col("name").isin(COMMON_NAMES), recv.isNull(), F.coalesce("imported", F.lit(False))
    one_top = F.col("n_top") == 1
    rules = [
        ("self", climbs & recv.isin("self", "cls") & (F.col("o_cls") != "") & (F.col("n_self") > 0), "self"),
        ("base", climbs & (F.col("n_base") > 0), "base"),
        ("local", bare & (F.col("n_local") > 0), "local"),
        ("import", bare & imported & one_top, "top"),
        ("unique", bare & ~imported & one_top & rare, "top"),
        ("class", ~bare & ~climbs & (F.col("n_class") > 0), "class"),
        ("unique", ~bare & ~climbs & (F.col("n_only") == 1) & rare, "only"),
    ]
    pick = F.lit(None).cast(f"struct<how:string,dst:{dict(nodes.dtypes)['id']},n:bigint>")
    for how, fits, source in reversed(rules):
        pick = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(how).alias("how"), F.col(f"d_{source}").alias("dst"), F.col(f"n_{source}").alias("n"))).otherwise(pick)
    picked = met.withColumn("pick", pick)
    kinds = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("d_kind"))
    sure = picked.filter("pick.n = 1 and pick.dst <> owner").select(F.col("owner").alias("src"), F.col("pick.dst").alias("dst"), "kind", "line", F.col("pick.how").alias("how")).join(kinds, "dst")
    kind = F.when((F.col("kind") == "call") & (F.col("d_kind") == "class"), "instantiate").otherwise(F.col("kind"))
    edges = first_edges(sure.select("src", "dst", kind.alias("kind"), "line", "how"))
    several = F.col("n_only").isNotNull() & (F.coalesce("pick.n", F.lit(0)) != 1)
    return edges, picked.agg(F.count_if(F.col("n_only").isNull()).alias("unresolved"), F.count_if(several).alias("ambiguous"))


def graph_stats(nodes: DataFrame, edges: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: nodes without modules, edges in all and by kind, references that did not become edges."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("call", "decorator", "instantiate", "inherit")]
    left = nodes.agg(F.count_if(F.col("kind") != "module").alias("nodes"))
    return left.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"), *kinds))).crossJoin(F.broadcast(counts))


def locate(rows: DataFrame, chunks: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """``rows`` with ``doc``: the first chunk of that path that holds the line, -1 if none does.

    A join on the path; the smallest doc is kept by an aggregation that combines before the shuffle.
    """
    keyed = rows.select(F.col(path).alias("_p"), F.col(line).alias("_l")).distinct()
    held = keyed.join(chunks.select(F.col("path").alias("_p"), "start_line", "end_line", F.col("doc").alias("_d")), "_p")
    held = held.filter(F.col("_l").between(F.col("start_line"), F.col("end_line"))).groupBy("_p", "_l").agg(F.min("_d").alias("_d"))
    on = rows[path].eqNullSafe(held["_p"]) & rows[line].eqNullSafe(held["_l"])
    return rows.join(held, on, "left").withColumn("doc", F.coalesce("_d", F.lit(-1).cast("long"))).drop("_p", "_l", "_d")


def expand(
    questions: DataFrame, ranked: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, extra: int = EXTRA, seeds: int = SEEDS
) -> DataFrame:
    """(qid, pos, doc, score, reason): chunks one edge away from a question's best hits that are not among its hits.

    ranked: every place of the ranking (qid, pos, doc, detail); the first ``k`` are the hits. Direction follows the question's
    wording; twice as many chunks are added when it asks for callers or callees. nodes: with ``doc``, the defining chunk.
    """
    hits = ranked.filter(F.col("pos") <= k).join(chunks.select("doc", F.col("kind").alias("_kind")), "doc")
    pinned = F.coalesce(F.col("detail.symbol"), F.lit(False))
    usable = hits.filter(pinned | ~F.col("_kind").isin("module", "module_part", "class_body"))
    order = Window.partitionBy("qid").orderBy(F.desc(pinned), "pos")
    seeded = usable.withColumn("seed", F.row_number().over(order)).filter(F.col("seed") <= seeds)
    weight = F.when((F.col("seed") == 1) | pinned, 1.0).otherwise(0.6)
    ways = questions.select("qid", T.intent("text").alias("way"))
    seeded = seeded.select("qid", "doc", "seed", weight.alias("weight")).join(ways, "qid")
    inside = seeded.join(nodes.filter("kind <> 'module'").select("doc", F.col("id").alias("node"), F.col("qual").alias("node_qual")), "doc").drop("doc")
    out = inside.filter("way <> 'callers'").join(edges, F.col("node") == edges.src).join(nodes.select(F.col("id").alias("dst"), "doc"), "dst")
    said = F.when(F.col("kind").isin("call", "instantiate"), F.concat("kind", F.lit("ed by "), "node_qual")).otherwise(F.concat("kind", F.lit(" of "), "node_qual"))
    visit = lambda side, *more: F.struct("seed", "node", F.lit(side).alias("side"), *more)
    out = out.select("qid", "doc", (F.col("weight") * F.when(F.col("way") == "callees", 2.0).otherwise(1.0)).alias("w"), said.alias("reason"), visit(0, F.lit("").alias("path"), "line", F.col("dst").alias("other")).alias("turn"))
    back = inside.filter("way <> 'callees'").join(edges, F.col("node") == edges.dst).join(nodes.select(F.col("id").alias("src"), F.col("path"), F.col("qual").alias("by")), "src")
    verb = F.when(F.col("kind") == "call", "calls").when(F.col("kind") == "instantiate", "creates").when(F.col("kind") == "decorator", "is decorated by").otherwise("subclasses")
    said = F.concat("by", F.lit(" "), verb, F.lit(" "), "node_qual", F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))
    back = locate(back, chunks).select("qid", "doc", (F.col("weight") * F.when(F.col("way") == "callers", 2.0).otherwise(0.75)).alias("w"), said.alias("reason"), visit(1, "path", "line", F.col("src").alias("other")).alias("turn"))
    near = out.unionByName(back).filter("doc >= 0").join(hits.select("qid", "doc"), ["qid", "doc"], "left_anti")
    near = near.groupBy("qid", "doc").agg(F.sum("w").alias("score"), F.min_by("reason", "turn").alias("reason"), F.min("turn").alias("turn"))
    near = near.join(ranked.select("qid", "doc", F.col("pos").alias("_at")), ["qid", "doc"], "left")
    near = near.withColumn("score", F.round(F.col("score") + F.coalesce(0.5 / (1 + (F.col("_at") - 1) / 10), F.lit(0.0)), 12)).join(ways, "qid")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "turn")
    limit = F.when(F.col("way") == "related", extra).otherwise(2 * extra)
    return near.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= limit).select("qid", "pos", "doc", "score", "reason")
