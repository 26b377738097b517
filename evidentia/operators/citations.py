"""Page paragraphs, reference lists and in-text citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_TEXT = "无法提取网页正文内容"
# Tags that end an unclosed paragraph.
BLOCK_TAGS = ("p div ul ol li table tr td th h1 h2 h3 h4 h5 h6 article section header footer nav aside main form "
              "blockquote pre hr body html").split()
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def paragraph_texts(html: Column) -> Column:
    """Texts of all paragraphs; an unclosed one ends at the next block tag."""
    blocks = "|".join(BLOCK_TAGS)
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?(?:{blocks})[\s>/]|$)"), F.lit(1))

    def clean(t):
        t = F.regexp_replace(t, "<[^>]*>", "")
        for k, v in ENTITIES.items():
            t = F.replace(t, F.lit(k), F.lit(v))
        return t

    return F.transform(found, clean)


def page_paragraphs(html: Column, min_len: int = 50, k: int = 5) -> Column:
    """First k paragraphs longer than ``min_len``, one per line, or a fixed text when there are none."""
    kept = F.slice(F.filter(paragraph_texts(html), lambda t: F.length(t) > min_len), 1, k)
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(NO_TEXT)


def combine_research(pages: DataFrame, topic: str, rank: str, title: str, html: str, k: int | None = None) -> DataFrame:
    """(topic, rank, block): the text block of every result, or of those with the first ``k`` ranks of a topic.

    A topic's text is its blocks in rank order; they stay rows, so a topic of any size is spread over tasks.
    """
    top = pages
    if k is not None:
        top = pages.withColumn("_r", F.row_number().over(Window.partitionBy(topic).orderBy(rank))).filter(F.col("_r") <= k)
    block = F.concat(F.lit("\n标题: "), F.coalesce(title, F.lit("无标题")), F.lit("\n"), page_paragraphs(F.col(html)), F.lit("\n\n" + "=" * 80 + "\n"))
    return top.select(topic, rank, block.alias("block"))


def apa_authors(authors: Column) -> Column:
    """``Last-FM`` for names of several words, single names as they are."""
    def one(name):
        parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != "")
        initials = F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, 1, 1)), "")
        return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -1), F.lit("-"), initials)).otherwise(F.element_at(parts, 1))

    return F.array_join(F.transform(authors, one), ", ")


def apa_year(summary: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(summary, r"\b([0-9]{4})\b", 1), F.lit("")), F.lit("n.d."))


def apa(papers: DataFrame) -> DataFrame:
    """Add ``apa_authors``, ``year`` and ``apa`` to (title, authors, summary, link)."""
    title = F.coalesce("title", F.lit("Unknown Title"))
    titled = F.array_join(F.transform(F.split(title, ": "), lambda p, i: F.when(
        i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, F.length(p)))).otherwise(p)), ": ")
    journal = F.coalesce(F.get(F.split("summary", " - "), F.lit(1)), F.lit("Unknown Journal"))
    p = papers.withColumn("apa_authors", apa_authors(F.col("authors"))).withColumn("year", apa_year(F.col("summary")))
    return p.withColumn("apa", F.concat("apa_authors", F.lit(". ("), "year", F.lit("). "), titled, F.lit(". "), journal, F.lit(". DOI: "), F.coalesce("link", F.lit(""))))


def in_text_citation(authors: Column, year: Column, index: Column) -> Column:
    """(A, year)[i], (A et B, year)[i] or (A et al, year)[i]."""
    a = F.split(authors, ", ")
    who = F.when(F.size(a) == 1, F.get(a, F.lit(0))).when(F.size(a) == 2, F.concat(F.get(a, F.lit(0)), F.lit(" et "), F.get(a, F.lit(1)))).otherwise(
        F.concat(F.get(a, F.lit(0)), F.lit(" et al")))
    return F.concat(F.lit("("), who, F.lit(", "), year, F.lit(")["), index.cast("string"), F.lit("]"))


def reference_list(papers: DataFrame, topic: str = "topic", rank: str = "paper_id", k: int = 25) -> DataFrame:
    """Numbered references per topic, the first k, with their in-text form."""
    top = papers.withColumn("index", F.row_number().over(Window.partitionBy(topic).orderBy(rank))).filter(F.col("index") <= k)
    a = apa(top)
    return a.select(topic, "index", F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), "apa").alias("reference"),
                    in_text_citation(F.col("apa_authors"), F.col("year"), F.col("index")).alias("citation"))


def insert_citations(df: DataFrame, key: str, text: str = "text", citations: str = "citations") -> DataFrame:
    """Add ``cited_text``: citations placed behind pieces of the text between sentence marks.

    A third of the pieces at most are taken, in the order of a hash of key and
    position, so a rerun gives the same text; headings are passed over.
    """
    marks = F.regexp_extract_all(F.col(text), F.lit("[.!?]"), F.lit(0))
    bits = F.split(F.col(text), "[.!?]")
    both = F.arrays_zip(bits.alias("bit"), marks.alias("mark"))  # pieces meet their marks side by side: an expression of the text within the lambda would read it once per piece
    d = df.withColumn("_p", F.flatten(F.transform(both, lambda x: F.array_compact(F.array(x["bit"], x["mark"])))))
    d = d.withColumn("_k", F.least(F.floor(F.size("_p") / 3), F.size(citations)).cast("int"))
    ranked = F.array_sort(F.transform("_p", lambda p, i: F.struct(
        F.md5(F.concat_ws(":", F.col(key).cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, F.col("_k")), lambda x: x["i"]))
    usable = F.filter(chosen, lambda i: ~F.rlike(F.get("_p", i), F.lit(r"^\s*#+\s")))
    d = d.withColumn("_at", F.when(F.col("_k") > 0, usable).otherwise(F.array().cast("array<int>")))
    placed = F.transform("_p", lambda p, i: F.when(F.array_contains("_at", i), F.concat(
        F.trim(p), F.lit(" "), F.get(citations, F.array_position("_at", i).cast("int") - 1))).otherwise(p))
    return d.withColumn("cited_text", F.array_join(placed, "")).drop("_p", "_k", "_at")
