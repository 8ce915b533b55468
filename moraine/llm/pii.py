"""Personal identifiers and secrets by bootstrapped contextual extraction.

Candidates are the places in a text that could hold an identifier by their form, and what follows a label such as `key =` whatever its form. Strict recognisers (with check digits where a
kind has them) take the seed entities. Every candidate carries lexical patterns: the two words before it, the word before or after it with the form of the value, a
label before it such as `key =`, and the form alone. Two words that are met before several seeds, and before little else, are a context: the texts are read once more for whatever follows
those, of any form, so that a context is judged by all that it stands before, and can discover names without a digit. Spark scores the bipartite graph of patterns and values in
rounds: a pattern by how far its values are known to be of a kind, a value that is no seed by its trusted patterns. Patterns of high confidence
so discover identifiers that no recogniser knows. A value that a recogniser refutes (a wrong check digit) is never taken.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .exchange import saved, workspace

ROUNDS, TRUST, SUPPORT, ACCEPT, SMOOTH = 3, 0.7, 3, 0.7, 1.0
MODEL_ROWS = 200_000

#: A run of characters is entered at its beginning only and never given back, so the time is linear in the text, whatever is in it.
CANDIDATE = re.compile(
    r"""
    (?<![\w.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+)+
  | (?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)
  | (?<![\w])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7})(?!\w)
  | (?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])
  | (?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)
  | (?<![\w.])\+?(?:\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?![\w])
  | (?<!\w)AKIA[0-9A-Z]{16}(?!\w)
  | (?<![\w/+-])(?=[A-Za-z_/+-]*+\d)[A-Za-z0-9_/+-]{8,}+(?:=){0,2}(?!\w)
    """,
    re.X,
)
#: IBANs in groups of four, IPv6 and MAC addresses: taken where they are valid, before the candidates above.
_GROUPED = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?!\w)")
_ADDRESS = re.compile(r"(?<![\w:.-])(?:[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?![\w:-])|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))")
#: What follows a label, whatever its form.
_LABELLED = re.compile(r"""[:=][ ]?["']?([^\s"'<>,;]++)""")
#: What a line has in which `CANDIDATE` can match: each of its forms has one of these, and none goes over the end of a line.
_HINT = re.compile(r"[0-9@]|AKIA")
_LETTERS = re.compile(r"[^\W\d_]++")
#: What may stand between the words of a context and before the value; and what follows a context.
_GAP = " \t,:;=(\"'-"
_NEXT = re.compile(r"""[ \t,:;=("'-]*+([^\s"'<>,;()]++)""")
_RIGHT = re.compile(r"""["')]?[ ]?([^\W\d_]++)""")
_SECRET = re.compile(r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api_?-?key|access_?-?key|auth|credential)s?$")


def _word_before(text: str, at: int) -> tuple[int, int]:
    """Where the run of letters that ends at a place begins and ends; none if the two are equal."""
    begin = at
    while begin and text[begin - 1].isalpha():
        begin -= 1
    return (at, at) if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_") else (begin, at)


def _context(text: str, at: int) -> str | None:
    """The two words right before a place, of the same sentence."""
    words: list[str] = []
    while len(words) < 2:
        end = at
        while end and text[end - 1] in _GAP:
            end -= 1
        begin, end = _word_before(text, end)
        if begin == end or end == at:
            return None
        words.append(text[begin:end].lower())
        at = begin
    return f"{words[1]} {words[0]}"


def _label(text: str, at: int) -> str | None:
    """The label that ends with `=` or `:` before a place: a whole run of ASCII letters, _ and -, however long."""
    if at and text[at - 1] in "\"'":
        at -= 1
    if at and text[at - 1] == " ":
        at -= 1
    if not at or text[at - 1] not in ":=":
        return None
    at -= 1
    if at and text[at - 1] == " ":
        at -= 1
    begin = at
    while begin and (text[begin - 1] in "_-" or text[begin - 1].isascii() and text[begin - 1].isalpha()):
        begin -= 1
    return text[begin:at] if at - begin >= 2 else None


def _previous_word(text: str, at: int) -> str | None:
    """The letters before a place, whatever else but letters, digits and _ is between."""
    while at and not (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    begin = at
    while begin and text[begin - 1].isalpha():
        begin -= 1
    return text[begin:at].lower() if begin < at else None


def _labelled(text: str):
    """(label, its mark, begin, end) of what follows labels."""
    at = 0
    while m := _LABELLED.search(text, at):
        label = _label(text, m.start() + 1)
        at = m.start() + 1 if label is None else m.end()
        if label is not None:
            yield label, text[m.start()], m.start(1), m.end(1)


def _hinted(text: str):
    """(begin, end) of the lines that have a hint of a candidate."""
    at = 0
    while m := _HINT.search(text, at):
        begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        at = len(text) if end < 0 else end
        yield begin, at


def _after(text: str, pairs):
    """(begin, end, context) of what follows a context in its sentence, whatever its form. pairs: the two words of each context."""
    words = _LETTERS.findall(text.lower())
    hits = [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in pairs]
    if not hits:
        return
    runs = [m.span() for m in _LETTERS.finditer(text)]
    if len(runs) != len(words):  # a character whose lower case is no letter
        hits = range(len(runs) - 1)
    inside = lambda at: 0 <= at < len(text) and (text[at].isdigit() or text[at] == "_")
    for i in hits:
        (a, b), (begin, end) = runs[i], runs[i + 1]
        if end == len(text) or text[end] not in _GAP or text[b:begin].strip(_GAP) or inside(a - 1) or inside(b) or inside(begin - 1):
            continue
        pair = text[a:b].lower(), text[begin:end].lower()
        if pair in pairs and (n := _NEXT.match(text, end)):
            value = n.group(1).rstrip(".,:)]}?!")
            if len(value) > 1:
                yield n.start(1), n.start(1) + len(value), " ".join(pair)


@lru_cache(maxsize=4)
def _pairs(contexts: frozenset[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(c.split(" ")) for c in contexts)


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _address(value: str) -> str | None:
    if re.fullmatch(r"\w\w([:-]\w\w){5}", value):
        return "MAC"
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    return "IP" if len(value) >= 6 and re.search(r"\d", value) else None


def _certain(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of IBANs in groups and of IPv6 and MAC addresses."""
    out = []
    addresses = _ADDRESS.finditer(text) if text.count(":") > 1 or text.count("-") > 4 else ()  # either has as many of these
    for m in _GROUPED.finditer(text):
        value = m.group()
        while len(value) > 14 and not _iban(value):  # a word after it may look like a group
            value = value[: value.rfind(" ")] if " " in value else ""
        if len(value.replace(" ", "")) >= 15:
            out.append((m.start(), m.start() + len(value), "IBAN"))
    return out + [(*m.span(), kind) for m in addresses if (kind := _address(m.group()))]


def recognise(value: str, label: str | None) -> tuple[str | None, bool]:
    """(kind of a seed or None, whether the value is refuted)."""
    if "@" in value:
        return ("EMAIL", False) if re.fullmatch(r"[\w.+%-]+@[\w-]+(\.[\w-]+)*\.[^\W\d_]{2,}", value) else (None, False)
    digits = re.sub(r"\D", "", value)
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", value):
        return ("IP", False) if all(int(x) < 256 for x in value.split(".")) else (None, True)
    if re.fullmatch(r"AKIA[0-9A-Z]{16}", value) or label and _SECRET.search(label):
        return "SECRET", False
    if re.fullmatch(r"[\d -]+", value) and 13 <= len(digits) <= 19:
        return ("CARD", False) if (digits[0] in "3456" or 2221 <= int(digits[:4]) <= 2720) and _luhn(digits) else (None, True)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        return ("SSN", False) if value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" else (None, True)
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", value):
        return ("IBAN", False) if _iban(value) else (None, True)
    if re.fullmatch(r"[+\d ().-]+", value):
        if 10 <= len(digits) <= 15 and re.fullmatch(r"(\+\d{1,3}[ .-]?.*|(1[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})", value):
            return "PHONE", False
        return None, len(digits) < 7
    return None, False


def form(value: str) -> str:
    """A value's form: hexadecimal or alphanumeric with its length, else its runs of letters and digits with its marks."""
    if re.fullmatch(r"[0-9a-f]+", value) and re.search("[a-f]", value):
        return f"hex{len(value)}"
    if value.isalnum() and not value.isdigit():
        return f"{'A' if value.isupper() else 'a'}9x{len(value)}"
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: f"9x{len(m.group())}" if value.isdigit() else "9", value))


def candidates(text: str, contexts: frozenset[str] = frozenset()) -> list[tuple[int, int, str, str | None, bool, list[str]]]:
    """(begin, end, value, seed kind, refuted, patterns) of each candidate; places count characters. What is one only because it follows a context has
    no pattern but that: a context that isn't trusted then decides nothing."""
    taken: list[tuple[int, int, str | None, bool | None]] = [(b, e, kind, False) for b, e, kind in _certain(text)]
    labelled = []
    for label, mark, begin, end in _labelled(text):
        value = text[begin:end].rstrip(".,:)]}?")
        if len(value) < 2 or value.startswith("//"):
            continue
        span = begin, begin + len(value)
        # letters alone after a colon may be prose: a candidate, but no seed
        if _SECRET.search(label) and (mark == "=" or not value.isalpha()):
            taken.append((*span, None if "@" not in value or recognise(value, None)[0] else "SECRET", None))
        else:
            labelled.append((*span, None, False))
    taken = _apart([], taken)
    taken = _apart(taken, [(*m.span(), None, None) for line in _hinted(text) for m in CANDIDATE.finditer(text, *line)])
    taken = _apart(taken, labelled)
    out = []
    if contexts:
        of = {(begin, end): context for begin, end, context in sorted(_after(text, _pairs(contexts)))}
        out += [(*span, text[span[0] : span[1]], None, False, [f"left {of[span]}"]) for span in _apart_from(taken, list(of))]
    for begin, end, kind, refuted in taken:
        value = text[begin:end]
        label = (_label(text, begin) or "").lower() or None
        if kind is None and refuted is None:
            kind, refuted = recognise(value, label)
        shape = form(value)
        patterns = [f"form {shape}"] if refuted is not False or not value.isalpha() else []
        if label:
            patterns += [f"label {label}", f"label {label} {shape}"]
        elif word := _previous_word(text, begin):
            patterns.append(f"word {word} {shape}")
        if context := _context(text, begin):
            patterns.append(f"left {context}")
        if (right := _RIGHT.match(text, end)) and not (refuted is False and value.isalpha()):
            patterns.append(f"right {right.group(1).lower()} {shape}")
        out.append((begin, end, value, kind, bool(refuted), patterns))
    return sorted(out, key=lambda x: x[:2])


def _apart_from(taken: list[tuple], more: list[tuple[int, int]]):  # taken: spans that begin with their place
    """The spans of more, which may overlap each other, that overlap none of those taken; both by place."""
    k = 0
    for begin, end in more:
        while k < len(taken) and taken[k][1] <= begin:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            yield begin, end


def _apart(first: list[tuple], more: list[tuple]) -> list[tuple]:
    """The spans of first and those of more that overlap none before them, by place."""
    out, last = [], 0
    blocked = sorted(first, key=lambda x: x[:2])
    k = 0
    for span in sorted(more, key=lambda x: x[:2]):
        while k < len(blocked) and blocked[k][1] <= span[0]:
            k += 1
        if span[0] >= last and (k == len(blocked) or blocked[k][0] >= span[1]):
            out.append(span)
            last = span[1]
    return sorted([*first, *out], key=lambda x: x[:2])


_CANDIDATES = "doc_id long, text_id long, row long, begin int, end int, value string, seed string, refuted boolean, patterns array<string>"


def _scan(contexts: frozenset[str] = frozenset()):
    def run(batches):
        row = TaskContext.get().partitionId() << 33  # a row of the input has a number of its own, which tells repeated ones apart
        for batch in batches:
            rows = []
            for i, t, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_id").to_pylist(), batch.column("text"), strict=True):
                rows += [(i, t, row, *c) for c in candidates(text.as_py(), contexts)]
                row += 1
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["doc_id", "text_id", "row", "begin", "end", "value", "seed", "refuted", "patterns"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), text).where("text is not null")


def _strangers(limits: dict[str, int]):
    """(context, value) of what follows contexts without being a candidate, in a task: of each context up to one more value than it may have, then it is given up with a null."""

    def run(batches):
        pairs, seen = set(_pairs(frozenset(limits))), {}
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                spans = sorted(_after(text, pairs))
                if not spans:
                    continue
                of = {span[:2]: span[2] for span in spans}
                for span in _apart_from([c[:2] for c in candidates(text)], list(of)):
                    context = of[span]
                    own = seen.setdefault(context, set())
                    own.add(text[span[0] : span[1]])
                    if len(own) > limits[context]:
                        own.add(None)
                        pairs.discard(tuple(context.split(" ")))
        rows = [(c, v) for c, own in seen.items() for v in ([None] if None in own else own)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["context", "value"])

    return run


def _found(docs: DataFrame, folder: str) -> tuple[DataFrame, list[frozenset[str]], DataFrame]:
    """(candidates, the contexts that were read for, in shares of at most MODEL_ROWS, all contexts that may count).

    A context stands before SUPPORT seeds or more, and of the different values that follow it TRUST or more are candidates by their form or a label. To
    tell, the texts are read once more where there are such contexts; a task gives one up with the first value too many, so what moves is a few values of each.
    Only where some of those left have others after them, the texts are read for them.
    """
    spark, texts = docs.sparkSession, _texts(docs)
    first = saved(texts.mapInArrow(tk.trimmed(_scan()), _CANDIDATES), folder, "candidates")
    left = first.select("value", F.col("seed").isNotNull().alias("known"), F.explode("patterns").alias("pattern")).where("pattern like 'left %'")
    left = left.groupBy(F.substring("pattern", 6, 1 << 30).alias("context"), "value").agg(F.bool_or("known").alias("known"))
    often = left.groupBy("context").agg(F.count("*").alias("n"), F.count_if("known").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    often = saved(often.select("context", F.floor(F.col("n") / TRUST - F.col("n") - SMOOTH + 1e-9).cast("long").alias("most")).where("most >= 0"), folder, "contexts")
    count = often.count()
    shares = max(1, -(-count // MODEL_ROWS)) if MODEL_ROWS > 0 else 1
    some = lambda df, k: df.where(F.pmod(F.xxhash64("context"), F.lit(shares)) == k).collect()
    others = spark.createDataFrame([], "context string, value string")
    for k in range(shares if count else 0):
        others = others.unionByName(saved(texts.mapInArrow(tk.trimmed(_strangers({r.context: r.most for r in some(often, k)})), "context string, value string"), folder, f"others{k}"))
    others = others.groupBy("context").agg(F.count_distinct("value").alias("n"), F.bool_or(F.col("value").isNull()).alias("over"))
    allowed = saved(often.join(others, "context", "left").where("n is null or not over and n <= most").select("context", F.col("n").isNotNull().alias("open")), folder, "allowed")
    rest = allowed.where("open").select("context")
    contexts, found = [], first
    if not rest.isEmpty():
        contexts = [frozenset(r.context for r in some(rest, k)) for k in range(shares)]
        reads = [saved(texts.mapInArrow(tk.trimmed(_scan(c)), _CANDIDATES), folder, f"context{k}") for k, c in enumerate(contexts)]
        found = reads[0]
        for read in reads[1:]:
            found = found.unionByName(read)
        if shares > 1:
            found = saved(found.dropDuplicates(["row", "begin", "end", "value"]), folder, "found")
    return found, contexts, allowed.select("context")


def learn(found: DataFrame, folder: str, allowed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score) of the trusted patterns, from candidates. allowed: the contexts that count, of those that patterns name."""
    edges = found.select("value", F.explode(F.array_distinct("patterns")).alias("pattern")).distinct()
    left = F.col("pattern").startswith("left ")
    edges = saved(edges.where(~left).unionByName(edges.where(left).join(allowed.select(F.concat(F.lit("left "), "context").alias("pattern")), "pattern", "left_semi")), folder, "edges")
    known = found.where("seed is not null").groupBy("value").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0))
    open_ = found.groupBy("value").agg(F.bool_or(F.col("seed").isNotNull() | F.col("refuted")).alias("closed")).where("not closed").select("value")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total")).where(F.col("total") >= SUPPORT)
    graph = saved(edges.join(totals, "pattern"), folder, "graph")
    seeds = saved(known, folder, "seeds")
    values, patterns = seeds, None
    for k in range(rounds):
        scored = graph.join(values, "value").groupBy("pattern", "kind", "total").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= 0.5).alias("support"))
        patterns = scored.where(F.col("support") >= SUPPORT).select("pattern", "kind", (F.col("mass") / (F.col("total") + F.lit(SMOOTH))).alias("score")).where(F.col("score") >= TRUST)
        patterns = saved(patterns, folder, f"patterns{k}")
        if k + 1 < rounds:
            guess = graph.join(open_, "value", "left_semi").join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
            values = seeds.unionByName(saved(guess, folder, f"values{k}"))
    return patterns


def _judged(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds kind, score and how it was found to the candidates that are taken."""
    key = ["doc_id", "text_id", "row", "begin", "end", "value"]
    seeds = found.where("seed is not null").select(*key, F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit("seed").alias("found_by"))
    rest = found.where("seed is null and not refuted").select(*key, F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    rest = rest.groupBy(*key, "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("score"))
    rest = rest.groupBy(*key).agg(F.max(F.struct("score", "kind")).alias("best")).where(F.col("best.score") >= ACCEPT)
    return seeds.unionByName(rest.select(*key, F.col("best.kind").alias("kind"), F.col("best.score").alias("score"), F.lit("pattern").alias("found_by")))


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end, value, kind, score, found_by): where the texts hold identifiers, places in characters.

    A null or empty text holds none; a null doc_id is kept in the rows of its text. Repeated rows give repeated rows. Whole texts are read. Other columns are not. An empty table gives no rows.
    """
    folder = workspace(docs.sparkSession)
    found, _, allowed = _found(docs, folder)
    return saved(_judged(found, learn(found, folder, allowed)).drop("text_id", "row"), folder, "result")


def _apply(model: dict[str, list[tuple[str, float]]], contexts: frozenset[str]):
    def redact(text: str) -> str:
        parts, at = [], 0
        for begin, end, _, seed, refuted, patterns in candidates(text, contexts):
            kind = seed
            if not kind and not refuted:
                left: dict[str, float] = {}
                for p in patterns:
                    for k, s in model.get(p, ()):
                        left[k] = left.get(k, 1.0) * (1 - s)
                best = max(((1 - v, k) for k, v in left.items()), default=(0.0, ""))
                kind = best[1] if best[0] >= ACCEPT else None
            if kind and begin >= at:
                parts += [text[at:begin], f"[{kind}]"]
                at = end
        return "".join([*parts, text[at:]])

    def run(batches):
        for batch in batches:
            texts = [redact(x.as_py()) for x in batch.column("text")]
            cols = [pa.array(texts, batch.schema.field("text").type) if n == "text" else pa.array([len(t) for t in texts], pa.int64()) if n == "n_chars" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def _replaced(batches):
    for batch in batches:
        texts = []
        for text, spots in zip(batch.column("text").to_pylist(), batch.column("__spots").to_pylist(), strict=True):
            parts, at = [], 0
            for s in spots or []:
                if s["begin"] >= at:
                    parts += [text[at : s["begin"]], f"[{s['kind']}]"]
                    at = s["end"]
            texts.append("".join([*parts, text[at:]]))
        names = [n for n in batch.schema.names if n != "__spots"]
        cols = [pa.array(texts, batch.schema.field("text").type) if n == "text" else pa.array([len(t) for t in texts], pa.int64()) if n == "n_chars" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each identifier replaced by its kind in brackets and `n_chars` the new length; every row and column stays.

    The trusted patterns go to the tasks where they are few (at most `MODEL_ROWS`, checked), so that no text is moved; beyond that
    the places found are joined to the documents that have any. Rows without a text never leave the JVM.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    found, contexts, allowed = _found(docs, folder)
    patterns = learn(found, folder, allowed)
    trusted = patterns.where("pattern like 'left %'").select(F.substring("pattern", 6, 1 << 30).alias("context")).distinct()
    typed = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in docs.columns else docs
    hit = F.col("text").isNotNull()
    rest, some = typed.where(~hit), typed.where(hit)
    if len(contexts) < 2 and patterns.count() <= MODEL_ROWS:
        model: dict[str, list[tuple[str, float]]] = {}
        for r in patterns.collect():
            model.setdefault(r.pattern, []).append((r.kind, r.score))
        own = frozenset(r.context for r in trusted.collect()) if contexts else frozenset()  # others can decide nothing
        done = some.mapInArrow(tk.trimmed(_apply(model, own)), typed.schema)
    else:
        spots = _judged(found, patterns).groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("begin", "end", "kind"))).alias("__spots"))
        joined = some.join(spots, F.xxhash64(some["text"]) == spots["text_id"], "left")
        done = joined.select(*typed.columns, "__spots").mapInArrow(tk.trimmed(_replaced), typed.schema)
    return rest.unionByName(done)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return identifiers(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
