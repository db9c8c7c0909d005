"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line, lower-cased with its ends stripped and inner blanks squeezed, is hashed to 128 bits. Per host (a column of the
input) we count the distinct documents that hold a line; copies of one text are one document. Lines above the host's
limit are removed, and a document that keeps too few of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import WORD, columns_but, fresh, joined_copies, let, words

#: A line is boilerplate in a host if more distinct documents than this hold it, however many the host has.
MAX_DOCUMENTS = 20
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5
#: The base rules: least words, and most percent of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


def _repeated(w: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more; w is bound by a lambda."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            twice = F.filter(
                s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            )
            return F.array_sort(F.transform(twice, lambda x: x["p"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(let(ordered, places), start, step, lambda a: a["n"])

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(some)


def word_features(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of one text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words(t), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r")))

    def as_struct(c: Column) -> Column:
        n, r = c["n"].cast("long"), c["r"].cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            r.alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        )

    return let(counted, as_struct)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _line_key(line: Column) -> Column:
    return let(normalised(line), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))


def _count_words(text: Column) -> Column:
    return F.size(words(text))


def _document(host: Column, text: Column) -> Column:
    """One string for a host and text; copies in one host share it."""
    return F.concat(F.md5(F.coalesce(text, F.lit(""))), F.coalesce(F.concat(F.lit("="), host), F.lit("-")))


def frequent_lines(docs: DataFrame, text: str, host: str, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(doc, line key a, b, n_words): the lines above the limit in each document of a host.

    n_words sums over the copies of the document. Rows of a line are counted through a distinct and a partial count, so
    a line that a third of all rows holds costs each task one row.
    """
    base = docs.select(F.col(host).alias("host"), _document(F.col(host), F.col(text)).alias("doc"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    kept = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    keyed = F.transform(kept, lambda x: F.struct(_line_key(x).alias("line"), _count_words(x).alias("n")))
    each = base.select("host", "doc", F.explode(keyed).alias("x"))
    lines = each.groupBy("host", "doc", F.col("x.line.a").alias("a"), F.col("x.line.b").alias("b")).agg(F.sum("x.n").alias("n_words"))
    # n_words is never null; counting it keeps this branch's shuffle the same as the other's, so that Spark makes it once
    counts = lines.groupBy("host", "a", "b").agg(F.count("n_words").alias("n"))
    above = counts.where(F.col("n") > max_documents).select(F.col("host").alias("of"), F.col("a").alias("la"), F.col("b").alias("lb"))
    same = F.col("host").eqNullSafe(F.col("of")) & (F.col("a") == F.col("la")) & (F.col("b") == F.col("lb"))
    return lines.join(above, same, "left_semi").select("doc", "a", "b", "n_words")


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", *, max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT, clean: bool = True
) -> DataFrame:
    """docs with struct columns `rules` (word_features), `removed_words` (long), `clean_text` and `kept`.

    clean=False leaves out the text and clean_text, so that no text is shuffled.

    Every row of docs comes back once, repeated rows too, whatever its id. Null text counts as empty: no words, base
    failed, not kept, clean_text null. A null host is a host of its own. An empty table gives an empty table. Columns
    of docs that have a name of ours, in any case, are replaced. Texts are taken whole, each in one expression of its
    task. Ties do not occur: a limit is passed only by a larger count.
    """
    key, hit = fresh(docs, "document_key"), fresh(docs, "hit")
    found = frequent_lines(docs, text, host, max_documents).groupBy(F.col("doc").alias(key))
    per_doc = found.agg(F.sum("n_words").alias("n_words"), F.collect_list(F.struct("a", "b")).alias("lines"))
    copies = docs.groupBy(_document(F.col(host), F.col(text)).alias(key)).agg(F.count("*").alias("copies"))
    own = docs.select(*columns_but(docs, "rules", "removed_words", "clean_text", "kept"))
    spread = F.xxhash64(*columns_but(own, text))
    own = own.withColumn(key, _document(F.col(host), F.col(text))).withColumn("rules", word_features(F.col(text)))
    if not clean:
        own = own.drop(text)
    joined = joined_copies(own, per_doc.join(copies, key), key, "copies", spread, hit)
    gone = F.floor(F.col(hit)["n_words"] / F.col(hit)["copies"]).cast("long")
    out = joined.withColumn("removed_words", F.coalesce(gone, F.lit(0).cast("long")))
    if clean:
        stays = lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(F.col(hit)["lines"], _line_key(x)))
        left = F.array_join(F.filter(F.split(F.col(text), "\n"), stays), "\n")
        out = out.withColumn("clean_text", F.when(F.col(hit).isNull(), F.col(text)).otherwise(left))
    enough = F.col("rules.n_words") - F.col("removed_words") >= F.col("rules.n_words") * F.lit(float(min_left))
    return out.withColumn("kept", ~F.col("rules.base_failed") & enough).drop(key, hit)


def verdicts(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, base_failed, removed_words and kept."""
    out = quality_rules(docs.select("doc_id", "text", "source"), clean=False)
    return out.select("doc_id", "rules.*", "removed_words", "kept")


#: DuckDB SQL for verdicts() over a table or subquery named {docs}.
SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t, md5(coalesce(text, '')) as h,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from {docs}),
texts as (select distinct h, w, t from d),
grams as (select h, w[i] as a, w[i + 1] as b, w[i + 2] as c, i from (select h, w, unnest(range(1, len(w) - 1)) as i from texts)),
twice as (select h, i from (select h, i, count(*) over (partition by h, a, b, c) as n from grams) where n > 1),
covered as (select h, count(distinct i + k) as n from twice, range(3) r(k) group by h),
lines as (select source, h, ln from (select source, h, unnest(string_split(t, chr(10))) as ln from (select distinct source, h, t from d))
          where regexp_matches(ln, '[^\x20\x09-\x0D]')),
dups as (select h, count(*) - count(distinct ln) as n from (select h, unnest(string_split(t, chr(10))) as ln from texts)
         where regexp_matches(ln, '[^\x20\x09-\x0D]') group by h),
norm as (select source, h, trim(regexp_replace(lower(ln), '[\x20\x09-\x0D]+', ' ', 'g')) as k,
                len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) as n from lines),
above as (select source, k from norm group by source, k having count(distinct h) > 20),
removed as (select norm.source, norm.h, sum(norm.n) as n from norm join above
            on norm.source is not distinct from above.source and norm.k = above.k group by norm.source, norm.h),
f as (select d.doc_id, d.t, cast(len(d.w) as bigint) as n_words, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
             cast(coalesce(dups.n, 0) as bigint) as n_dup_lines, cast(coalesce(removed.n, 0) as bigint) as removed_words
      from d left join covered on d.h = covered.h left join dups on d.h = dups.h
      left join removed on d.h = removed.h and d.source is not distinct from removed.source)
select doc_id, n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
       cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
       n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, removed_words,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - removed_words >= n_words * cast(0.5 as double) as kept
from f
"""
