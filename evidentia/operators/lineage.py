"""Values that carry the characters they came from.

A tracked value is a struct column (value, spans, op, note); its spans are
(doc_id, start, end, doc_sha) over half-open character ranges. ``Tracked``
builds such columns and remembers, on the driver, which inputs each one was
derived from, so the derivation graph can be written out as node and edge rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import sha16
from evidentia.session import stage

#: Characters in a block of a source's text.
BLOCK = 4096
SPAN_TYPE = "struct<doc_id:string,start:int,end:int,doc_sha:string>"
TRACKED_TYPE = f"struct<value:double,spans:array<{SPAN_TYPE}>,op:string,note:string>"


def span(doc_id: Column, start: Column, end: Column, doc_sha: Column) -> Column:
    return F.struct(doc_id.alias("doc_id"), start.cast("int").alias("start"), end.cast("int").alias("end"), doc_sha.alias("doc_sha"))


def span_union(*spans: Column) -> Column:
    """Spans of several inputs in order, each kept once."""
    return F.array_distinct(F.concat(*spans))


class Tracked:
    """Column expressions of one tracked value and the inputs it was derived from."""

    def __init__(self, value: Column, spans: Column, op: str = "extract", note: Column | None = None,
                 inputs: tuple[Tracked, ...] = ()):
        self.value, self.spans, self.op, self.inputs = value, spans, op, inputs
        self.note = F.lit("") if note is None else note

    @staticmethod
    def leaf(col: str) -> Tracked:
        """Wrap a stored tracked struct column."""
        c = F.col(col)
        return Tracked(c["value"], c["spans"], "extract", c["note"])

    @staticmethod
    def at(value: Column, doc_id: Column, start: Column, end: Column, doc_sha: Column, note: Column | None = None) -> Tracked:
        return Tracked(value, F.array(span(doc_id, start, end, doc_sha)), "extract", note)

    def column(self) -> Column:
        return F.when(self.value.isNotNull(), F.struct(
            self.value.cast("double").alias("value"), self.spans.alias("spans"), F.lit(self.op).alias("op"), self.note.alias("note")))

    def _derive(self, value: Column, op: str, other=None) -> Tracked:
        if isinstance(other, Tracked):
            return Tracked(value, span_union(self.spans, other.spans), op, inputs=(self, other))
        return Tracked(value, F.array_distinct(self.spans), op, inputs=(self,))

    @staticmethod
    def _plain(other):
        return other.value if isinstance(other, Tracked) else other

    def __add__(self, other):
        return self._derive(self.value + self._plain(other), "add", other)

    __radd__ = __add__

    def __sub__(self, other):
        return self._derive(self.value - self._plain(other), "sub", other)

    def __mul__(self, other):
        return self._derive(self.value * self._plain(other), "mul", other)

    __rmul__ = __mul__

    def __truediv__(self, other):
        """Null, and so no tracked value, where the divisor is zero."""
        return self._derive(F.try_divide(self.value, F.lit(self._plain(other))), "div", other)

    def __neg__(self):
        return self._derive(-self.value, "neg")

    def __lt__(self, other):
        return self.value < self._plain(other)

    def same_as(self, other) -> Column:
        """Equality of the plain values."""
        return self.value == self._plain(other)

    def apply(self, fn: Callable[[Column], Column], name: str | None = None) -> Tracked:
        """Lift any function of a column, a pandas UDF included, keeping the spans."""
        return self._derive(fn(self.value), name or getattr(fn, "__name__", "apply"))

    def walk(self) -> list[Tracked]:
        """Distinct values of the derivation, this one first."""
        seen, out = set(), []

        def visit(n):
            if id(n) not in seen:
                seen.add(id(n))
                out.append(n)
                for i in n.inputs:
                    visit(i)

        visit(self)
        return out

    def node_id(self, number: int) -> Column:
        """Identity of the value that has this number in its derivation: two derived values are never one node, equal as they may be."""
        places = F.transform(self.spans, lambda s: F.concat_ws(":", s["doc_id"], s["start"].cast("string"), s["end"].cast("string")))
        return sha16(F.concat_ws("|", F.lit(self.op), F.lit(str(number)), F.array_join(places, ","), F.format_string("%.6f", self.value.cast("double"))))


def untrack(col: str) -> Column:
    return F.col(col)["value"]


def derivation_graph(df: DataFrame, key: list[str], root: Tracked) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roots) rows of one derived value per key; rows where it is null are left out."""
    held = df.filter(root.value.isNotNull())
    members = root.walk()
    ids = {id(n): n.node_id(i) for i, n in enumerate(members)}
    nodes = held.select(*key, F.explode(F.array(*[F.struct(
        ids[id(n)].alias("node_id"), F.lit(i).alias("number"), F.lit(n.op).alias("op"), n.value.cast("double").alias("value"), n.note.alias("note"),
        n.spans.alias("spans")) for i, n in enumerate(members)])).alias("n")).select(*key, "n.*")
    uses = [F.struct(ids[id(i)].alias("src"), ids[id(n)].alias("dst"), F.lit(k).alias("pos"),
                     F.lit(m).alias("number")) for m, n in enumerate(members) for k, i in enumerate(n.inputs)]
    none = F.array().cast("array<struct<src:string,dst:string,pos:int,number:int>>")
    edges = held.select(*key, F.explode(F.array(*uses) if uses else none).alias("e")).select(*key, "e.*")
    roots = held.select(*key, ids[id(root)].alias("node_id"))
    return nodes, edges, roots


def derivation_graphs(df: DataFrame, key: list[str], derived: dict[str, Tracked], name: str = "metric") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roots) of several derived values per key, told apart by ``name``.

    The rows are read once and every node is made once: derivations are staged
    as one row each, and so are their edges, which a walk reads once per step.
    """
    made, uses = [], F.lit(None).cast("array<struct<src:string,dst:string,pos:int,number:int>>")
    for n, root in derived.items():
        members = root.walk()
        place = {id(m): i for i, m in enumerate(members)}
        nodes = F.array(*[F.struct(
            m.node_id(i).alias("node_id"), F.lit(i).alias("number"), F.lit(m.op).alias("op"), m.value.cast("double").alias("value"), m.note.alias("note"),
            m.spans.alias("spans")) for i, m in enumerate(members)])
        made.append(F.when(root.value.isNotNull(), F.struct(F.lit(n).alias(name), nodes.alias("nodes"))))
        at = lambda i: F.get("nodes", F.lit(i))["node_id"]
        own = [F.struct(at(place[id(i)]).alias("src"), at(m).alias("dst"), F.lit(k).alias("pos"), F.lit(m).alias("number"))
               for m, x in enumerate(members) for k, i in enumerate(x.inputs)]
        uses = F.when(F.col(name) == n, F.array(*own)).otherwise(uses) if own else uses
    graphs = df.select(*key, F.explode(F.array_compact(F.array(*made))).alias("g")).select(*key, f"g.{name}", "g.nodes")
    graphs = stage(graphs, "derivations")
    nodes = graphs.select(*key, name, F.explode("nodes").alias("n")).select(*key, name, "n.*")
    edges = stage(graphs.select(*key, name, F.explode(uses).alias("e")).select(*key, name, "e.*"), "uses")
    return nodes, edges, graphs.select(*key, name, F.get("nodes", F.lit(0))["node_id"].alias("node_id"))


def explain(nodes: DataFrame, edges: DataFrame, roots: DataFrame, key: list[str], max_depth: int = 6) -> DataFrame:
    """Pre-order walk of every derivation: (key, path, depth, op, value, note, spans at leaves).

    One recursive query: its depth is that of the derivations, and planning runs no
    job. Shared nodes appear once per path; ``path`` is the list of input positions,
    and sorting by it gives the order.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(max_depth + 2, int(spark.conf.get("spark.sql.cteRecursionLevelLimit", "100")))))
    names, same = ", ".join(key), " AND ".join(f"w.{k} <=> e.{k}" for k in key)
    walk = spark.sql(
        f"""WITH RECURSIVE walk({names}, node_id, path) AS (
          SELECT {names}, node_id, CAST(array() AS array<int>) FROM {{roots}}
          UNION ALL
          SELECT {', '.join(f'w.{k}' for k in key)}, e.src, concat(w.path, array(e.pos))
          FROM walk w JOIN {{edges}} e ON {same} AND w.node_id = e.dst WHERE size(w.path) < {int(max_depth)})
        SELECT {names}, node_id, path FROM walk""", roots=roots, edges=edges)
    inner = edges.select(*key, F.col("dst").alias("node_id")).distinct().withColumn("_inner", F.lit(1))
    told = nodes.join(inner, [*key, "node_id"], "left").withColumn("_leaf", F.col("_inner").isNull())
    return walk.join(told, [*key, "node_id"]).select(
        *key, "path", F.size("path").alias("depth"), "op", "value", "note", F.when(F.col("_leaf"), F.col("spans")).alias("leaf_spans"))


def longest_path(root: Column, uses: Column) -> Column:
    """Steps on the longest way from ``root`` along ``uses`` (src, dst) of a derivation, which has no cycles.

    Each round moves every node below all that use it; as many rounds as nodes are
    enough. Nodes shared by many ways cost no more than others.
    """
    none = F.map_from_arrays(F.array(root), F.array(F.lit(0)))
    depth = lambda d, n: F.coalesce(F.try_element_at(d, n), F.lit(-1))

    def round_(d: Column, _: Column) -> Column:
        below = F.transform(F.filter(uses, lambda u: depth(d, u["dst"]) >= 0), lambda u: F.struct(u["src"].alias("k"), (depth(d, u["dst"]) + 1).alias("v")))
        names = F.array_distinct(F.concat(F.map_keys(d), F.transform(below, lambda x: x["k"])))
        deepest = lambda n: F.greatest(depth(d, n), F.coalesce(F.array_max(F.transform(F.filter(below, lambda x: x["k"] == n), lambda x: x["v"])), F.lit(-1)))
        return F.map_from_arrays(names, F.transform(names, deepest))

    return F.aggregate(F.sequence(F.lit(1), F.size(F.array_distinct(F.transform(uses, lambda u: u["dst"]))) + 1), none, round_,
                       lambda d: F.array_max(F.map_values(d)))


def graph_stats(nodes: DataFrame, edges: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """Nodes, edges, depth (longest path), leaves and operations per derivation.

    A derivation's nodes and uses are one row: it has as many as its expression has
    operands. Derivations whose uses are equal once nodes are numbered have one
    shape, and the depth is worked out once per shape.
    """
    order = [c for c in ("number", "pos") if c in edges.columns]
    uses = edges.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, "src", "dst"))).alias("_uses"))
    n = nodes.groupBy(*key).agg(F.collect_list("node_id").alias("_ids"), F.array_join(F.array_sort(F.collect_set("op")), ",").alias("ops"))
    own = n.join(roots.select(*key, F.col("node_id").alias("_root")), key).join(uses, key, "left")
    src, dst = (F.coalesce(F.col("_uses")[c], F.array().cast("array<string>")) for c in ("src", "dst"))
    own = own.select(*key, "_ids", "ops", dst.alias("_dst"), F.arrays_zip(src.alias("src"), dst.alias("dst")).alias("_uses"),
                     F.array_distinct(F.concat(F.array("_root"), src, dst)).alias("_names"))
    number = lambda x: F.array_position("_names", x).cast("int")
    counted = own.select(
        *key, F.size("_ids").cast("long").alias("n_nodes"), F.size("_uses").cast("long").alias("n_edges"),
        F.transform("_uses", lambda u: F.struct(number(u["src"]).alias("src"), number(u["dst"]).alias("dst"))).alias("_shape"),
        F.size(F.filter("_ids", lambda x: ~F.array_contains("_dst", x))).cast("long").alias("n_leaves"), "ops")
    shapes = counted.select("_shape").distinct().withColumn("depth", longest_path(F.lit(1), F.col("_shape")))
    return counted.join(shapes, "_shape").select(*key, "n_nodes", "n_edges", "depth", "n_leaves", "ops")


def to_dot(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Digraph lines per derivation: (key, section, place, line), in this order; nodes and then edges go by their number in the derivation."""
    quote = F.lit('"')
    n = nodes.select(*key, F.lit(1).alias("section"), F.struct("number", F.lit(0).alias("pos")).alias("place"), F.concat(
        F.lit("  n"), "node_id", F.lit(" [label="), quote, "op", F.lit("\\n"), F.format_string("%.6f", "value"), quote, F.lit("];")).alias("line"))
    e = edges.select(*key, F.lit(2).alias("section"), F.struct("number", "pos").alias("place"),
                     F.concat(F.lit("  n"), "src", F.lit(" -> n"), "dst", F.lit(";")).alias("line"))
    text = ["digraph lineage {", "  rankdir=BT;", "  node [shape=box];", "}"]
    frame = nodes.select(*key).distinct().select(*key, F.explode(F.array(*[F.struct(
        F.lit(3 if t == "}" else 0).alias("section"), F.struct(F.lit(i).alias("number"), F.lit(0).alias("pos")).alias("place"), F.lit(t).alias("line"))
        for i, t in enumerate(text)])).alias("f")).select(*key, "f.*")
    return frame.unionByName(n).unionByName(e)


# --- extraction ------------------------------------------------------------

def extract(docs: DataFrame, before: str, figure: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """First place where ``before`` is followed by ``figure``, with the characters of the figure.

    (doc_id, raw, value, start, end, doc_sha). The two parts are regular
    expressions without groups, matched without regard to case. Separators are
    dropped before the number is read; no match or no number gives no row.
    """
    t = F.col(text)
    whole = f"(?is)^(.*?(?:{before}))({figure})"
    head, raw = F.regexp_extract(t, whole, 1), F.regexp_extract(t, whole, 2)
    out = docs.select(F.col(doc_id).cast("string").alias("doc_id"), raw.alias("raw"), F.length(head).alias("start"),
                      sha16(t).alias("doc_sha"), F.rlike(t, F.lit(whole)).alias("_hit")).filter("_hit")
    return out.select("doc_id", "raw", F.regexp_replace("raw", ",", "").try_cast("double").alias("value"), "start",
                      (F.col("start") + F.length("raw")).alias("end"), "doc_sha").filter(F.col("value").isNotNull())


def extract_pattern(docs: DataFrame, pattern: str, group: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``extract`` for any Python pattern: whole texts in Arrow batches, for what the built-ins cannot locate."""
    import re

    @F.pandas_udf("struct<raw:string,start:int,end:int>")
    def find(texts: pd.Series) -> pd.DataFrame:
        compiled = re.compile(pattern, re.I)
        found = [compiled.search(x) if x is not None else None for x in texts]
        hit = [m is not None and m.group(group) is not None for m in found]
        return pd.DataFrame({
            "raw": [m.group(group) if h else None for m, h in zip(found, hit)],
            "start": pd.array([m.start(group) if h else None for m, h in zip(found, hit)], dtype="Int32"),
            "end": pd.array([m.end(group) if h else None for m, h in zip(found, hit)], dtype="Int32")})

    out = docs.select(F.col(doc_id).cast("string").alias("doc_id"), find(text).alias("m"), sha16(F.col(text)).alias("doc_sha"))
    return out.filter(F.col("m.raw").isNotNull()).select(
        "doc_id", "m.raw", F.regexp_replace("m.raw", ",", "").try_cast("double").alias("value"), "m.start", "m.end", "doc_sha"
    ).filter(F.col("value").isNotNull())


def find_span(text: Column, value: Column, accn: Column, end: Column) -> Column:
    """struct(start, end) of a fact's digits inside its own JSON object, or null.

    The object is the first one naming both the accession and the period end
    whose value agrees once trailing dots and zeros are off both sides. An
    object's first occurrence in the text is where it stands, since an equal
    one further on would not be the first.
    """
    digits = r'(?s)^(.*?"val"\s*:\s*)(-?[0-9.]+)'
    bare = lambda c: F.rtrim(c, F.lit(".0"))
    objects = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    fits = F.filter(objects, lambda o: F.contains(o, accn) & F.contains(o, end)
                    & F.rlike(o, F.lit(digits)) & (bare(F.regexp_extract(o, digits, 2)) == bare(value)))
    obj = F.get(fits, F.lit(0))
    at = F.call_function("locate", obj, text) - 1 + F.length(F.regexp_extract(obj, digits, 1))
    return F.when(obj.isNotNull(), F.struct(
        at.cast("int").alias("start"), (at + F.length(F.regexp_extract(obj, digits, 2))).cast("int").alias("end")))


# --- evidence and verification --------------------------------------------

def value_spans(values: DataFrame, key: list[str], col: str = "tracked") -> DataFrame:
    """One row per span of each value, in order."""
    return values.select(*key, F.posexplode(F.col(col)["spans"]).alias("span_no", "s")).select(*key, "span_no", "s.*")


def text_index(sources: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources cut into blocks: heads (doc_id, current_sha, n_chars, block_shas) and blocks (doc_id, block, piece).

    Heads are narrow; a span joins the blocks that it touches, so no whole text is
    sent for one.
    """
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{block or BLOCK}}}"), F.lit(0))
    heads = sources.filter("text IS NOT NULL").select(
        "doc_id", sha16(F.col("text")).alias("current_sha"), F.length("text").alias("n_chars"), F.transform(pieces, sha16).alias("block_shas"))
    return heads, sources.select("doc_id", F.posexplode(pieces).alias("block", "piece"))


def span_texts(spans: DataFrame, blocks: DataFrame, key: list[str], block: int | None = None) -> DataFrame:
    """(key, span_no, found): the characters of every span as far as there are any.

    Spans (with their key, span_no, doc_id, start, end) go to the blocks that they
    touch; pieces of one span, seldom more than one, are put together by its number.
    """
    size = F.lit(block or BLOCK)
    low, high = F.greatest(F.col("start"), F.lit(0)), F.col("end")
    of = lambda at: F.floor(at / size).cast("int")
    touched = spans.filter((high > low) & F.col("start").isNotNull()).select(
        *key, "span_no", "doc_id", low.alias("start"), "end", F.explode(F.sequence(of(low), of(high - 1))).alias("block"))
    met = touched.join(blocks, ["doc_id", "block"])
    first = F.greatest(F.col("start") - F.col("block") * size, F.lit(0))
    part = F.substr("piece", first + 1, F.least(F.col("end") - F.col("block") * size, size) - first)
    return met.groupBy(*key, "span_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", part.alias("part")))), lambda x: x["part"]), "").alias("found"))


def evidence(values: DataFrame, sources: DataFrame, key: list[str], col: str = "tracked") -> DataFrame:
    """The characters behind every span; null where the source is not supplied."""
    s = value_spans(values, key, col)
    heads, blocks = text_index(sources)
    there = s.join(heads.select("doc_id", F.lit(True).alias("_there")), "doc_id", "left")
    return there.join(span_texts(s, blocks, key), [*key, "span_no"], "left").select(
        *key, "span_no", "doc_id", "start", "end", F.when(F.col("_there"), F.coalesce("found", F.lit(""))).alias("evidence"))


def checked_spans(spans: DataFrame, sources: DataFrame, key: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Spans with ``present``, ``issue`` (the first check that fails), ``current_sha``, ``expected`` and ``actual`` text."""
    heads, blocks = text_index(sources)
    j = spans.join(heads.select("doc_id", "current_sha", "n_chars"), "doc_id", "left").join(span_texts(spans, blocks, key), [*key, "span_no"], "left")
    if expected is not None:
        j = j.join(expected.select("doc_id", "start", "end", "expected"), ["doc_id", "start", "end"], "left")
    else:
        j = j.withColumn("expected", F.lit(None).cast("string"))
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_chars"))
    return with_issue(j.withColumn("actual", F.when(inside, F.col("found"))), inside).drop("found", "n_chars")


def with_issue(spans: DataFrame, inside: Column) -> DataFrame:
    """Add ``present`` and ``issue`` from ``current_sha`` (null without a source), ``doc_sha``, ``expected`` and ``actual``."""
    # The wording of the problems.
    issue = (
        F.when(F.col("current_sha").isNull(), "source not supplied")
        .when((F.coalesce("doc_sha", F.lit("")) != "") & (F.col("doc_sha") != F.col("current_sha")), "document has changed")
        .when(~inside, "span out of bounds")
        .when(F.col("expected").isNotNull() & (F.col("actual") != F.col("expected")), "text mismatch"))
    return spans.withColumn("present", F.col("current_sha").isNotNull()).withColumn("issue", issue)


def span_problems(values: DataFrame, sources: DataFrame, key: list[str], col: str = "tracked",
                  expected: DataFrame | None = None) -> DataFrame:
    """One row per span that no longer describes its source: where it is, what is wrong, both hashes and both texts."""
    p = checked_spans(value_spans(values, key, col), sources, key, expected).filter(F.col("issue").isNotNull())
    return p.select(*key, "span_no", "doc_id", "start", "end", "issue", F.col("doc_sha").alias("recorded_sha"), "current_sha", "expected", "actual")


def verify_against(values: DataFrame, sources: DataFrame, key: list[str], col: str = "tracked",
                   expected: DataFrame | None = None) -> DataFrame:
    """Per value: spans, spans checked, and whether all still describe their sources."""
    return _verdict(checked_spans(value_spans(values, key, col), sources, key, expected), key)


def _verdict(p: DataFrame, key: list[str]) -> DataFrame:
    return p.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("present").cast("int")).alias("n_checked"),
        F.count("issue").alias("n_problems"), F.min_by("issue", F.when(F.col("issue").isNotNull(), F.col("span_no"))).alias("first_issue"), (F.count("issue") == 0).alias("ok"))


def tamper_probe(values: DataFrame, sources: DataFrame, key: list[str], col: str = "tracked") -> DataFrame:
    """Change the first digit of each value's first span and verify the value against that; ``ok`` must come out false.

    Only the block that holds the digit is fetched and hashed anew. A source is as
    recorded while all of its block hashes are; with one changed, its hash is that of
    the changed list, and every span of the value in that source meets it.
    """
    heads, blocks = text_index(sources)
    at = F.get(F.col(f"{col}.spans"), F.lit(0))
    size = F.lit(BLOCK)
    first = values.select(*key, at["doc_id"].alias("doc_id"), F.floor(at["start"] / size).cast("int").alias("block"), (at["start"] % size + 1).alias("_at"))
    digit = F.substr("piece", F.col("_at"), F.lit(1))
    broken = F.overlay(F.col("piece"), F.when(digit == "9", "8").otherwise("9"), F.col("_at"), F.lit(1))
    hit = first.join(blocks, ["doc_id", "block"]).select(*key, "doc_id", "block", sha16(broken).alias("_sha"))
    spans = value_spans(values, key, col)
    j = spans.join(heads, "doc_id", "left").join(hit, [*key, "doc_id"], "left")
    now = F.transform("block_shas", lambda x, i: F.when(i == F.col("block"), F.col("_sha")).otherwise(x))
    changed = F.col("_sha").isNotNull() & (now != F.col("block_shas"))
    j = j.withColumn("current_sha", F.when(changed, sha16(F.array_join(now, ","))).otherwise(F.col("current_sha")))
    none = F.lit(None).cast("string")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_chars"))
    return _verdict(with_issue(j.withColumn("expected", none).withColumn("actual", none), inside), key)


def metric_card(values: DataFrame, sources: DataFrame, key: list[str], col: str = "tracked", stats: DataFrame | None = None) -> DataFrame:
    """Rounded value, operation, documents, the evidence characters and, with ``stats`` of its derivation, the depth of each value."""
    ev = evidence(values, sources, key, col).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_spans"), F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("documents"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "evidence"))), lambda x: x["evidence"]), ",").alias("evidence"))
    card = values.select(*key, F.round(F.col(col)["value"], 6).alias("value"), F.col(col)["op"].alias("op")).join(ev, key)
    return card if stats is None else card.join(stats.select(*key, "depth"), key, "left")
