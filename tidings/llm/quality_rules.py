"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Rules are Boolean columns over the text, its words and statistics, each of which is computed when a rule first asks for it.
On a bounded sample each rule's selectivity (share of rows it rejects) and cost (seconds of a job that evaluates that
rule alone, less those of a job that evaluates none) are estimated; the rules then run in the order of rejections per cost
inside one CASE expression, so that a row stops at the first rule that rejects it and never computes what later rules
need. The order changes the work, never the verdict, which is the conjunction of all rules.

The query's contract wants the base statistics of every row, so judged() computes those for all and lets rows that no base
rule rejects enter the cascade; filtered() puts all rules into it.

Nulls and empty texts have no words and all-zero statistics; the first base rule rejects them. Repeated rows are each
judged on their own. Columns other than doc_id and text are ignored whatever their names. Very long texts cost O(n log n). An empty
table gives no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import GAP, dropped, written

#: Rows of the sample that only sets the order, drawn by a hash of the text from the partitions that it takes to find them, and
#: the longest text in it: at most 50 MB come to the driver.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_SHARE = 500, 100_000, 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, use) -> Column:
    """use(value) with value computed once for each row, whatever use does with it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; split makes one empty string of a text without words, which goes."""
    return F.filter(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), GAP), lambda x: x != "")


def repeated_words(w: Column, span: int = 5) -> Column:
    """How many words of the array lie in a window of span words that the array has twice or more."""

    def covered(h: Column) -> Column:
        # hash and place of each window, sorted: equal windows become neighbours
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, j: F.get(s, j)["h"] == x["h"]
            kept = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | ((j < last) & F.coalesce(same(x, j + 1), F.lit(False))))
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        def total(p: Column) -> Column:
            step = lambda x, j: F.least(F.lit(span), F.coalesce(F.get(p, j + 1) - x, F.lit(span)))
            return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, starts), total))

    def hashes(x: Column) -> Column:
        return F.transform(F.slice(x, 1, F.greatest(F.size(x) - (span - 1), F.lit(0))), lambda _, i: F.xxhash64(*[F.get(x, i + k) for k in range(span)]))

    return let(w, lambda x: let(hashes(x), covered)).cast("long")


class Statistics(dict):
    """The base statistics of a text and its words by name, built when first asked for. Each is a long; all but n_symbols are 0 without words."""

    def __init__(self, text: Column, w: Column):
        super().__init__()
        self.text, self.w = F.coalesce(text, F.lit("")), w

    def __missing__(self, name: str) -> Column:
        self[name] = getattr(self, name)().cast("long")
        return self[name]

    def n_words(self):
        return F.size(self.w)

    def word_chars(self):
        return F.length(F.array_join(self.w, ""))

    def n_symbols(self):
        return F.length(self.text) - F.length(F.translate(self.text, SYMBOLS, ""))

    def n_dup_lines(self):
        return let(lines(self.text), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def n_repeat_words(self):
        return repeated_words(self.w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def amount(text: Column, others: str) -> Column:
    """How many characters a text has, runs of ``others`` left out."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), others, ""))


@dataclass(frozen=True)
class Rule:
    """A row is rejected where test(text, words, statistics) is true."""

    name: str
    test: object


def line_share(text: Column, test, parts: int, of: int) -> Column:
    """Whether more than parts / of of the lines meet the test."""
    return let(lines(text), lambda x: F.size(F.filter(x, test)) * of > F.size(x) * parts)


def bullet(line: Column) -> Column:
    return F.substring(F.ltrim(line, F.lit(SPACES)), 1, 1).isin("-", "*", "\u2022")


def trails_off(line: Column) -> Column:
    return let(F.rtrim(line, F.lit(SPACES)), lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("\u2026")))


#: Base rules are fixed by the query's contract.
BASE = (
    Rule("short", lambda t, w, s: s["n_words"] < 10),
    Rule("repeats", lambda t, w, s: s["n_repeat_words"] * 100 > s["n_words"] * 20),
)
#: Shares beyond which a text is no prose. The first three read base statistics, the others what only they need.
MORE = (
    Rule("symbols", lambda t, w, s: s["n_symbols"] * 10 > s["n_words"]),
    Rule("word_length", lambda t, w, s: (s["word_chars"] < s["n_words"] * 2) | (s["word_chars"] > s["n_words"] * 15)),
    Rule("dup_lines", lambda t, w, s: s["n_dup_lines"] * 10 > s["n_words"]),
    Rule("no_letters", lambda t, w, s: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*")) * 2 < s["n_words"]),
    Rule("few_words", lambda t, w, s: F.size(F.array_distinct(w)) * 5 < F.least(s["n_words"], F.lit(200))),
    Rule("upper_case", lambda t, w, s: amount(t, "[^A-Z]+") * 2 > amount(t, "[^A-Za-z]+")),
    Rule("digits", lambda t, w, s: amount(t, "[^0-9]+") * 2 > F.length(t)),
    Rule("bullets", lambda t, w, s: line_share(t, bullet, 9, 10)),
    Rule("ellipses", lambda t, w, s: line_share(t, trails_off, 3, 10)),
)


def measured_order(docs: DataFrame, rules, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """The rules by rejections per second, most first, as measured on sample_rows rows (a documented bound)."""
    t = docs.select(F.col(text).cast("string").alias("text"))
    # as the last step a limit reads no more partitions than it needs
    rows = t.filter((F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0) & (F.length("text") <= SAMPLE_CHARS)).limit(sample_rows).collect()
    sample = written(docs.sparkSession.createDataFrame(rows, "text string").coalesce(1), "rule-sample")

    def run(*columns) -> tuple[float, list]:
        began = time.perf_counter()
        got = sample.agg(*columns).first()
        return time.perf_counter() - began, got

    rejects = [F.count_if(verdict([r], F.col("text")).isNotNull()) for r in rules]
    _, rejected = run(*rejects)
    none = min(run(F.count_if(F.length("text") < 0))[0] for _ in range(2))
    scored = [(n / max(1e-4, run(one)[0] - none), r) for n, one, r in zip(rejected, rejects, rules)]
    dropped(sample)
    return [r for _, r in sorted(scored, key=lambda x: (-x[0], x[1].name))]


def cascade(rules, text: Column, w: Column, stats: dict) -> Column:
    """The name of the first rule that rejects the row, null if none does; later rules are not evaluated."""
    out = None
    for rule in rules:
        test = rule.test(text, w, stats)
        out = F.when(test, rule.name) if out is None else out.when(test, rule.name)
    return out


def verdict(rules, text: Column) -> Column:
    """The cascade over a text: words are split once, all else is computed when a rule first asks."""
    t = F.coalesce(text, F.lit(""))
    return let(words(text), lambda w: cascade(rules, t, w, Statistics(text, w)))


def filtered(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    return docs.filter(verdict(measured_order(docs, (*BASE, *MORE), sample_rows), F.col("text").cast("string")).isNull())


def judged(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each document's statistics, base verdict and verdict."""
    order, t = measured_order(docs, MORE, sample_rows), F.coalesce(F.col("text").cast("string"), F.lit(""))

    def row(w: Column) -> Column:
        stats = Statistics(t, w)

        def verdicts(s: Column) -> Column:
            known = {k: s[k] for k in NAMES}
            failed = cascade(BASE, t, w, known).isNotNull()
            kept = F.when(failed, False).otherwise(cascade(order, t, w, known).isNull())
            return F.struct(*[known[k].alias(k) for k in NAMES], failed.alias("base_failed"), kept.alias("kept"))

        return let(F.struct(*[stats[k].alias(k) for k in NAMES]), verdicts)

    return docs.select("doc_id", let(words(t), row).alias("s")).select("doc_id", "s.*")


ORACLE = r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select r, i, list_slice(w, i, i + 4) as five from w, unnest(range(1, len(w) - 3)) as u(i) where len(w) >= 5),
twice as (select r, i from (select r, i, count(*) over (partition by r, five) as n from g) where n > 1),
rep as (select r, count(distinct i + k) as n from twice, unnest(range(0, 5)) as v(k) group by r),
s as (select t.doc_id, len(w)::bigint as n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
             len(list_filter(w, lambda x: not regexp_matches(x, '\p{L}'))) * 2 > len(w)
             or len(list_distinct(w)) * 5 < least(len(w), 200)
             or length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 > length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
             or length(regexp_replace(text, '[^0-9]', '', 'g')) * 2 > length(text)
             or len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) * 10 > len(l) * 9
             or len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) * 10 > len(l) * 3 as odd
      from t join w using (r) left join rep using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (n_symbols * 10 > n_words or word_chars < n_words * 2 or word_chars > n_words * 15
       or n_dup_lines * 10 > n_words or odd) as kept
from b
"""
