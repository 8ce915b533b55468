"""Line-first cleaning: rules on each line, then on what a document has lost. Built-in expressions only.

A line goes if it fails one of the rules:

* punctuation: many marks that prose doesn't use for its number of words, or no sentence
  punctuation anywhere in a line of many words;
* navigation: separators between most of the words (of scripts without blanks, two letters are a word), or a menu entry alone on its line;
* boilerplate: a licence, copyright, cookie or sign-up phrase in a line that isn't long, or the same few words over and over.

Blank lines fail none. Then a document goes that kept less than `min_share` of its characters outside blank lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = r"[!#$%&*+/<=>@\\^_`{|}~]"
MARK_SHARE, MIN_MARKS = 0.25, 3
UNPUNCTUATED_WORDS = 12
SENTENCE = r"[.!?…。！？।؟:;]"
SEPARATORS = r"[|»›•·→¦]"
SEPARATOR_SHARE, MIN_SEPARATORS = 0.2, 2
MENU = (
    r"(?i)^[ \t]*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back|share|print|top|skip to content|contact us|about us|site map|sitemap|"
    r"startseite|impressum|anmelden|suche|weiter|accueil|connexion|rechercher|inicio|iniciar sesión|buscar)[ \t]*$"
)
BOILERPLATE = (
    r"(?i)(licensed under|general public license|creative commons|all rights reserved|copyright ©|© ?[12][0-9]{3}|copyright \(c\)|terms of (use|service)|privacy policy|use of cookies|"
    r"uses cookies|accept (all )?cookies|click here|read more|subscribe to|sign up for|enable javascript|powered by|lorem ipsum|spdx-license|alle rechte vorbehalten|datenschutzerklärung|"
    r"tous droits réservés|mentions légales|todos los derechos reservados|política de privacidad)"
)
BOILERPLATE_WORDS = 60
#: Fewer distinct words than both this share and this multiple of the root of their number: the vocabulary of prose grows faster than that.
REPEATED_WORDS, DISTINCT_SHARE, DISTINCT_ROOT = 20, 0.15, 6.0
BLANKS = " \t\r"
#: Letters of scripts that set no blanks between words (Thai to Lao, Myanmar, Khmer, kana, Han): for the shares of marks and separators two of them count as a word.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
MIN_SHARE = 0.4


def _passes(x: Column) -> Column:
    line, words = x["line"], x["words"]
    n = F.size(words)
    marks = F.length(line) - F.length(F.regexp_replace(line, F.lit(MARKS), F.lit("")))
    separators = F.length(line) - F.length(F.regexp_replace(line, F.lit(SEPARATORS), F.lit("")))
    of_shares = n + (F.length(line) - F.length(F.regexp_replace(line, F.lit(UNSPACED), F.lit("")))) / F.lit(2)
    bad_punctuation = (marks >= MIN_MARKS) & (marks > of_shares * MARK_SHARE) | (n >= UNPUNCTUATED_WORDS) & ~F.rlike(line, F.lit(SENTENCE))
    navigation = (separators >= MIN_SEPARATORS) & (separators >= of_shares * SEPARATOR_SHARE) | F.rlike(line, F.lit(MENU))
    boilerplate = (n <= BOILERPLATE_WORDS) & F.rlike(line, F.lit(BOILERPLATE)) | (n >= REPEATED_WORDS) & (F.size(F.array_distinct(words)) < F.least(n * F.lit(DISTINCT_SHARE), F.sqrt(n) * F.lit(DISTINCT_ROOT)))
    return ~(bad_punctuation | navigation | boilerplate)


def clean(docs: DataFrame, min_share: float = MIN_SHARE, counts: bool = True) -> DataFrame:
    """The documents that keep enough of their text, with `text` reduced to the lines that pass and `n_chars` its length.

    All other columns pass through; with `counts`, `n_lines` and `n_removed` are added (a column of the input with one
    of these names is replaced). A null text, an empty one and one of blanks keep nothing and go, as
    does a text without any line that passes. Rows are judged one by one: repeated rows stay repeated. An empty table gives no
    rows. One pass without a shuffle.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.struct(s.alias("line"), F.split(s, " ", -1).alias("words")))
    added = ("n_lines", "n_removed", "n_chars") if counts else ("n_chars",)
    names = [c for c in docs.columns if c not in added]
    size = lambda array: F.aggregate(array, F.lit(0), lambda n, s: n + F.length(F.btrim(s, F.lit(BLANKS))))
    step = docs.withColumns({"__moraine_all": F.split("text", "\n", -1), "__moraine_kept": F.transform(F.filter(lines, _passes), lambda x: x["line"])})
    step = step.withColumns({"__moraine_before": size("__moraine_all"), "__moraine_after": size("__moraine_kept")})
    step = step.where((F.col("__moraine_after") > 0) & (F.col("__moraine_after") >= F.col("__moraine_before") * F.lit(min_share)))
    out = F.array_join("__moraine_kept", "\n")
    cols = [out.alias(c) if c == "text" else F.col(f"`{c}`") for c in names]
    values = [F.length(out).cast("long"), F.size("__moraine_all"), F.size("__moraine_all") - F.size("__moraine_kept")]
    more = dict(zip(("n_chars", "n_lines", "n_removed"), values, strict=True))
    return step.select(*cols, *(v.alias(n) for n, v in more.items() if n in added))


def stage(docs: DataFrame) -> DataFrame:
    """`clean` with the columns of the input, all but text and n_chars as they were."""
    return clean(docs, counts=False).select(*(f"`{c}`" for c in docs.columns))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(table: str = "documents") -> str:
    marks = f"length(x) - length(regexp_replace(x, {_q(MARKS)}, '', 'g'))"
    seps = f"length(x) - length(regexp_replace(x, {_q(SEPARATORS)}, '', 'g'))"
    n = "len(string_split(x, ' '))"
    shares = f"({n} + (length(x) - length(regexp_replace(x, {_q(UNSPACED)}, '', 'g'))) / 2.0::DOUBLE)"
    fails = (
        f"({marks} >= {MIN_MARKS} AND {marks} > {shares} * {MARK_SHARE}::DOUBLE) OR ({n} >= {UNPUNCTUATED_WORDS} AND NOT regexp_matches(x, {_q(SENTENCE)}))"
        f" OR ({seps} >= {MIN_SEPARATORS} AND {seps} >= {shares} * {SEPARATOR_SHARE}::DOUBLE) OR regexp_matches(x, {_q(MENU)})"
        f" OR ({n} <= {BOILERPLATE_WORDS} AND regexp_matches(x, {_q(BOILERPLATE)})) OR ({n} >= {REPEATED_WORDS} AND len(list_distinct(string_split(x, ' '))) < least({n} * {DISTINCT_SHARE}::DOUBLE, sqrt({n}) * {DISTINCT_ROOT}::DOUBLE))"
    )
    size = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: length(trim(x, ' ' || chr(9) || chr(13))))), 0)"
    return (
        f"SELECT doc_id, array_to_string(kept, chr(10)) AS text, lang, source, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(kept) AS INTEGER) AS n_removed "
        f"FROM (SELECT *, list_filter(lines, lambda x: NOT ({fails})) AS kept FROM (SELECT *, string_split(text, chr(10)) AS lines FROM {table})) "
        f"WHERE {size('kept')} > 0 AND {size('kept')} >= {size('lines')} * {MIN_SHARE}"
    )


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE = {"op3_quality_rules": clean_sql()}
