"""Message routing, word filters and context windows; the same functions serve batch and stream."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import words as W

QUOTE_MARK = "」\n- - - - - - -"
ALL_GROUP = "ALL_GROUP"
RELOAD_COMMAND = "#更新配置"


@dataclass(frozen=True)
class RoutingRules:
    """Configured lists; they are short and become literals of the plan."""

    group_names: list[str] = field(default_factory=list)
    group_name_keywords: list[str] = field(default_factory=list)
    group_prefixes: list[str] = field(default_factory=list)
    group_keywords: list[str] = field(default_factory=list)
    single_prefixes: list[str] = field(default_factory=lambda: [""])
    shared_groups: list[str] = field(default_factory=list)
    group_at_off: bool = False
    trigger_by_self: bool = True
    bot_id: str = "BOT"
    bot_name: str = "bot"
    display_name: str | None = None


def check_prefix(content: Column, prefixes: list[str]) -> Column:
    """First prefix, in list order, the text starts with; null if none."""
    if not prefixes:
        return F.lit(None).cast("string")
    return F.get(F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(content, p)), F.lit(0))


def check_contain(content: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(content, F.lit(k))
    return out


def strip(content: Column) -> Column:
    """Whitespace of any kind off both ends."""
    return F.regexp_replace(content, r"(?U)^\s+|\s+$", "")


def strip_prefix(content: Column, prefix: Column) -> Column:
    """Take the matched prefix off the front and trim."""
    cut = F.substring(content, F.length(prefix) + 1, F.length(content))
    return F.when(F.coalesce(F.length(prefix), F.lit(0)) > 0, strip(cut)).otherwise(content)


def strip_mention(content: Column, name: str, display_name: str | None = None) -> Column:
    """Drop ``@name`` before a space or U+2005; failing that, the group display name."""
    quoted = lambda n: "@\\Q" + n + "\\E(\u2005|\u0020)"
    first = F.regexp_replace(content, quoted(name), "")
    if not display_name:
        return first
    return F.when(first == content, F.regexp_replace(content, quoted(display_name), "")).otherwise(first)


def drop_quoted_and_self(messages: DataFrame, rules: RoutingRules) -> DataFrame:
    keep = ~F.contains("content", F.lit(QUOTE_MARK))
    if not rules.trigger_by_self:
        keep = keep & (F.col("from_user_id") != rules.bot_id)
    return messages.filter(keep)


def session_key(rules: RoutingRules) -> Column:
    """Listed groups share one session, other groups split by sender, private chats by peer."""
    shared = F.lit(ALL_GROUP in rules.shared_groups) | F.col("group_name").isin(*(rules.shared_groups or [""]))
    return F.when(F.col("is_group"), F.when(shared, F.col("group_id")).otherwise(F.col("actual_user_id"))).otherwise(F.col("other_user_id"))


def route_messages(messages: DataFrame, rules: RoutingRules) -> DataFrame:
    """Accepted messages with cleaned content and session; stateless, one projection and filter."""
    m = drop_quoted_and_self(messages, rules)
    known = F.lit(ALL_GROUP in rules.group_names) | F.col("group_name").isin(*(rules.group_names or [""]))
    if rules.group_name_keywords:
        known = known | check_contain(F.col("group_name"), rules.group_name_keywords)
    m = m.withColumn("_gp", check_prefix(F.col("content"), rules.group_prefixes)).withColumn(
        "_sp", check_prefix(F.col("content"), rules.single_prefixes))
    called = F.col("_gp").isNotNull() | check_contain(F.col("content"), rules.group_keywords)
    if not rules.group_at_off:
        called = called | F.col("is_at")
    group_text = strip_prefix(F.col("content"), F.col("_gp"))
    group_text = F.when(F.col("is_at"), strip_mention(group_text, rules.bot_name, rules.display_name)).otherwise(group_text)
    single_text = strip(strip_prefix(F.col("content"), F.col("_sp")))
    accepted = F.when(F.col("is_group"), known & called).otherwise(F.col("_sp").isNotNull())
    return m.filter(accepted).withColumn("content", strip(F.when(F.col("is_group"), group_text).otherwise(single_text))).withColumn(
        "session_id", session_key(rules)).drop("_gp", "_sp")


def service_hours(messages: DataFrame, start: str = "00:00", stop: str = "24:00", ts: str = "create_time") -> DataFrame:
    """Messages inside the service hours, compared as HH:mm text; the reload command always passes."""
    return messages.filter(F.date_format(ts, "HH:mm").between(start, stop) | (F.col("content") == RELOAD_COMMAND))


# --- replies and lookups ---------------------------------------------------

def keyword_reply(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Messages equal to a keyword, with the typed reply."""
    r = replies.select(F.col("keyword").alias("_k"), F.col("reply"))
    image = F.rlike("reply", F.lit("^https?://")) & F.rlike("reply", F.lit(r"(?s)\.(jpg|jpeg|png|gif|webp)$"))
    return messages.join(r, strip(F.col("content")) == F.col("_k")).drop("_k").withColumn(
        "reply_type", F.when(image, "IMAGE_URL").otherwise("TEXT"))


def lookup_with_default(messages: DataFrame, apps: DataFrame, key: str = "group_name") -> DataFrame:
    """App code of the group, else that of the ALL_GROUP row."""
    default = apps.filter(F.col("name") == ALL_GROUP).agg(F.max("app").alias("_default"))
    a = apps.select(F.col("name").alias(key), F.col("app").alias("_app"))
    return messages.join(a, key, "left").join(F.broadcast(default)).withColumn(
        "app", F.coalesce(F.nullif("_app", F.lit("")), F.col("_default"))).drop("_app", "_default")


def closest_role(names: DataFrame, roles: list[str], min_sim: float = 0.35, col: str = "name") -> DataFrame:
    """Add ``role``: the exact lower-case match, else the most similar role; a later role wins ties."""
    import difflib

    @F.pandas_udf("string")
    def best(values: pd.Series) -> pd.Series:
        def one(name):
            top, found = min_sim, None
            for role in roles:
                sim = difflib.SequenceMatcher(None, name, role).ratio()
                if sim >= top:
                    top, found = sim, role
            return found
        return values.map(one)

    distinct = names.select(F.lower(col).alias("_low")).distinct()
    exact = F.when(F.col("_low").isin(*roles), F.col("_low"))
    matched = distinct.select("_low", F.coalesce(exact, best("_low")).alias("role"))
    return names.withColumn("_low", F.lower(col)).join(matched, "_low").drop("_low")


# --- word filters ----------------------------------------------------------

# The wording of answers that hold back banned words.
MASKED_MESSAGE, MASKED_REPLY = "发言中包含敏感词，请重试: \n", "已替换回复中的敏感词: \n"


def contains_banned(content: Column, words: list[str]) -> Column:
    """Whether a text holds a banned word, for lists of any length."""
    return W.has_word(content, words)


def find_banned(messages: DataFrame, words: list[str], key: list[str], text: str = "content") -> DataFrame:
    """(key, keyword, start, end, index) of all occurrences of any number of words; ends are inclusive."""
    return W.occurrences(messages, words, text, key)


def first_banned(found: DataFrame, key: list[str]) -> DataFrame:
    """The match that ends first; at equal ends the longest."""
    return found.groupBy(*key).agg(F.min_by(F.struct("keyword", "start", "end"), F.struct("end", "start")).alias("f")).select(*key, "f.*")


def mask_banned(messages: DataFrame, words: list[str], text: str = "content", mark: str = "*") -> DataFrame:
    """Add ``masked``: every character of every occurrence replaced."""
    return messages.withColumn("masked", W.masked(F.col(text), words, mark))


def banned_actions(messages: DataFrame, words: list[str], action: str = "ignore", text: str = "content") -> DataFrame:
    """Drop messages holding a banned word, or answer them with the masked text in ``reply``."""
    held = contains_banned(F.col(text), words)
    if action == "ignore":
        return messages.filter(~held).withColumn("reply", F.lit(None).cast("string"))
    return messages.withColumn("reply", F.when(held, F.concat(F.lit(MASKED_MESSAGE), W.masked(F.col(text), words))))


def banned_replies(replies: DataFrame, words: list[str], action: str = "ignore", text: str = "reply", kind: str = "reply_type") -> DataFrame:
    """Replies before they are sent: those of type TEXT that hold a banned word are dropped, or sent masked as INFO; others pass."""
    held = F.col(kind).eqNullSafe("TEXT") & contains_banned(F.col(text), words)
    if action == "ignore":
        return replies.filter(~held)
    sent = {text: F.when(held, F.concat(F.lit(MASKED_REPLY), W.masked(F.col(text), words))).otherwise(F.col(text)),
            kind: F.when(held, F.lit("INFO")).otherwise(F.col(kind))}
    return replies.select(*[sent[c].alias(c) if c in sent else F.col(c) for c in replies.columns])


def chunk_utf8(df: DataFrame, key: list[str], text: str, max_bytes: int, max_split: int = 0) -> DataFrame:
    """(key, pos, chunk): pieces of at most ``max_bytes``, never cut inside a character; an empty or null text has none.

    After ``max_split`` pieces the rest stays one piece. A piece ends where the
    limit falls, or up to three bytes before it if these continue a character.
    """
    if max_bytes < 4:
        raise ValueError("a character may take four bytes")
    own = df.select(*key, F.col(text).cast("binary").alias("_raw")).withColumn("_size", F.coalesce(F.octet_length("_raw"), F.lit(0)))
    size = F.col("_size")

    def whole(at: Column) -> Column:
        inside = lambda p: F.hex(F.substring(F.col("_raw"), p + 1, F.lit(1))).between("80", "BF")
        return F.when(at >= size, size).when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        to = whole(at + max_bytes)
        return (F.when(i > max_split, size).otherwise(to) if max_split > 0 else to), at

    steps = F.greatest(F.ceil(size / (max_bytes - 3)).cast("int"), F.lit(1))
    steps = F.least(steps, F.lit(max_split + 1)) if max_split > 0 else steps
    starts = F.filter(W.gathered(F.sequence(F.lit(1), steps), F.lit(0), step), lambda s: s < size)
    piece = lambda own: F.transform(own, lambda s, i: F.substring(F.col("_raw"), s + 1, F.coalesce(F.get(own, i + 1), size) - s).cast("string"))
    return own.select(*key, F.posexplode_outer(W.let(starts, piece)).alias("pos", "chunk")).filter("pos IS NOT NULL")


# --- context windows -------------------------------------------------------

def tail_cost(df: DataFrame, key: list[str], order: str, cost: Column, bucket: int = 1024) -> DataFrame:
    """Add ``_tail``: the cost of this row and all later ones of its key.

    Bucket totals are summed from the end first, then rows inside their bucket,
    so one very long conversation is spread over many tasks.
    """
    d = df.withColumn("_cost", cost).withColumn("_b", F.floor(F.col(order) / bucket))
    totals = d.groupBy(*key, "_b").agg(F.sum("_cost").alias("_s"))
    later = Window.partitionBy(*key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(*key, "_b", F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_after"))
    local = Window.partitionBy(*key, "_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(opening, [*key, "_b"]).withColumn("_tail", F.col("_after") + F.sum("_cost").over(local)).drop("_b", "_after")


def fit_context(turns: DataFrame, tokens: Column, budget: int = 1000, key: str = "conv_id", order: str = "turn",
                per_message: int = 4, priming: int = 3) -> DataFrame:
    """Turns kept within a token budget: system rows, then the longest run of latest turns that fits.

    A last user turn stays even when too long; a last assistant turn does not.
    """
    cost = tokens + per_message
    is_system = F.col("role") == "system"
    heads = turns.groupBy(key).agg(
        F.coalesce(F.sum(F.when(is_system, cost)), F.lit(0)).alias("_sys"), F.max(F.when(~is_system, F.col(order))).alias("_last"))
    rest = tail_cost(turns.filter(~is_system), [key], order, cost).join(heads, key)
    fits = F.col("_tail") + F.col("_sys") + priming <= budget
    forced = (F.col(order) == F.col("_last")) & (F.col("role") == "user")
    kept = rest.filter(fits | forced).select(*turns.columns)
    return turns.filter(is_system).select(*turns.columns).unionByName(kept)


def fit_context_pairs(turns: DataFrame, tokens: Column, budget: int = 1000, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Variant without system rows that drops the two oldest turns at a time; an odd last turn always stays."""
    said = turns.filter(F.col("role") != "system")
    ends = said.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    placed = tail_cost(said, [key], order, F.lit(1)).join(ends, key).withColumn(
        "_pair", F.floor((F.col("_n") - F.col("_tail")) / 2)).drop("_cost", "_tail")
    pair_rows = placed.groupBy(key, "_pair").agg(F.sum(tokens).alias("_pc"))
    pair_tail = tail_cost(pair_rows, [key], "_pair", F.col("_pc")).select(key, "_pair", "_tail")
    odd_last = (F.col("_n") % 2 == 1) & (F.col("_pair") == F.floor((F.col("_n") - 1) / 2))
    return placed.join(pair_tail, [key, "_pair"]).filter((F.col("_tail") <= budget) | odd_last).select(*turns.columns)


def rendered(role: str = "role", text: str = "text") -> Column:
    """A turn as plain dialogue text."""
    r, t = F.col(role), F.col(text)
    return (F.when(r == "system", F.concat(t, F.lit("<|endoftext|>\n\n\n"))).when(r == "user", F.concat(F.lit("Q: "), t, F.lit("\n")))
            .otherwise(F.concat(F.lit("\n\nA: "), t, F.lit("<|endoftext|>\n"))))


def fit_context_plain(turns: DataFrame, budget: int = 1000, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Variant that protects nothing: the cost is the length of the rendered dialogue."""
    last = turns.groupBy(key).agg(F.max_by(F.struct(F.col(order).alias("o"), "role"), order).alias("_l"))
    r = tail_cost(turns, [key], order, F.length(rendered())).join(last, key)
    prompt = F.when(F.col("_l.role") == "user", 3).otherwise(0)
    forced = (F.col(order) == F.col("_l.o")) & (F.col("role") != "assistant")
    return r.filter((F.col("_tail") + prompt <= budget) | forced).select(*turns.columns)


def render_dialog(kept: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One text per conversation from turns already cut to a budget, which bounds what is gathered."""
    g = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, rendered().alias("line"), "role"))).alias("t"))
    tail = F.when(F.element_at("t", -1)["role"] == "user", "A: ").otherwise("")
    return g.select(key, F.concat(F.array_join(F.col("t.line"), ""), tail).alias("dialog"))


#: Tokens added per message and per session.
TOKEN_FORMS = {"gpt-3.5": (4, 3), "gpt-4": (3, 3), "plain": (0, 0)}


def session_tokens(turns: DataFrame, tokens: Column, form: str = "gpt-3.5", key: str = "conv_id") -> DataFrame:
    """Token count of each session in one of three forms; the last is the plain character count."""
    return session_tokens_by_form(turns, tokens, [form], key).drop("form")


def session_tokens_by_form(turns: DataFrame, tokens: Column, forms: list[str], key: str = "conv_id") -> DataFrame:
    """(key, form, tokens) in several forms from one sum: a form adds so much per message and per session."""
    sums = turns.groupBy(key).agg(F.sum(tokens).alias("_t"), F.count(tokens).alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), (F.col("_t") + F.col("_n") * TOKEN_FORMS[f][0] + TOKEN_FORMS[f][1]).alias("tokens"))
                               for f in forms])).alias("x")
    return sums.select(key, each).select(key, "x.form", "x.tokens")
