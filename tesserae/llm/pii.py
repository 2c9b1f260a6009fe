"""Personal data by patterns of characters and, bootstrapped from them, of context.

1. A narrow pass finds e-mail and IP addresses, card and phone numbers by
   their form. It also notes the two words before and the two words after
   each of them, and each other token of LEAST_TOKEN characters at least that
   holds a digit or an @.
2. Spark scores the graph of contexts and tokens in rounds. A context is as
   confident about a kind as the distinct tokens it stands beside are known
   to be of that kind; a token that enough confident contexts stand beside
   becomes known itself and counts in the next round. Rounds end when nothing
   new is found.
3. Tokens so discovered become spans of the kind of their contexts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read, unused
from tesserae.llm.tokens import texts_of

KINDS = ("email", "ip", "card", "phone")
#: A context or token counts from this confidence on; doubts added to each context's tokens.
CONFIDENT, DOUBT = 0.8, 2.0
#: Characters of the shortest token that can be discovered.
LEAST_TOKEN = 5

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive forms of the patterns for numbers: equal matches, without trying a run again from its middle
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S++")
EDGES = ".,;:!?()[]{}<>\"'="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str):
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost first, found from their @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of personal data by form, ordered; kind counts in KINDS, positions in code points."""
    if not ANY.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in CARD.finditer(text):
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def _words(part: str) -> list[str]:
    return [w for x in part.lower().split() if (w := x.strip(EDGES))]


def _contexts(text: str, start: int, end: int) -> list[str]:
    """The two words before a span and the two after it, "^" where the text ends."""
    size, before = 64, []
    while len(before) < 2:
        at = max(0, start - size)
        before, size = _words(text[at:start] if not at else text[at:start].partition(" ")[2]), size * 8
        if not at:
            before = ["^", "^", *before]
    size, after = 64, []
    while len(after) < 2:
        at = min(len(text), end + size)
        after, size = _words(text[end:at] if at == len(text) else text[end:at].rpartition(" ")[0]), size * 8
        if at == len(text):
            after += ["^", "^"]
    return [" ".join([*before[-2:], "<"]), " ".join([">", *after[:2]])]


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Identifiers with their contexts: those found by form (kind set) and tokens that look like one (kind null)."""
    if not ANY.search(text):
        return []
    out = [{"start": s, "end": e, "kind": KINDS[k], "token": text[s:e].lower(), "contexts": _contexts(text, s, e)} for s, k, e in spans]
    at = 0
    for m in TOKEN.finditer(text):
        token = m.group()
        if not ANY.search(token):
            continue
        core = token.strip(EDGES)
        start = m.start() + len(token) - len(token.lstrip(EDGES))
        end = start + len(core)
        while at < len(spans) and spans[at][0] < start and spans[at][2] <= start:
            at += 1
        if len(core) >= LEAST_TOKEN and not any(s < end and start < e for s, _, e in spans[at:] if s < end):
            out.append({"start": start, "end": end, "kind": None, "token": core.lower(), "contexts": _contexts(text, start, end)})
    return out


def joined(spans) -> str:
    """kind:start:end by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


MENTION = "struct<start:long,end:long,kind:string,token:string,contexts:array<string>>"


def scan(docs: DataFrame) -> DataFrame:
    """For rows (id, mark, text): id, mark, spans by form (start, kind, end) and mentions."""
    id_type = docs.dtypes[0][1]
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    mention = pa.struct([("start", pa.int64()), ("end", pa.int64()), *((n, pa.string()) for n in ("kind", "token")), ("contexts", pa.list_(pa.string()))])

    def find(batches):
        for batch in batches:
            spans, seen = [], []
            for text in texts_of(batch.column(2)):
                text = (text or b"").decode()
                found = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                seen.append(mentions(text, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(seen, pa.list_(mention))], names=["id", "mark", "spans", "mentions"])

    return docs.mapInArrow(find, f"id {id_type}, mark string, spans array<struct<start:long,kind:int,end:long>>, mentions array<{MENTION}>")


def discover(edges: DataFrame, cuts: Cuts, confident: float = CONFIDENT, doubt: float = DOUBT) -> DataFrame:
    """(token, kind) of the tokens that confident contexts discover.

    edges: distinct (context, token) with a column for each kind, 1 where
    the token is of it by form.
    """
    total = lambda k: F.least(F.lit(1.0), F.col(k))
    found, known = None, 0
    while True:
        state = edges
        if found is not None:
            state = edges.join(found.withColumnRenamed("kind", "new"), "token", "left").select("context", "token", "form", *(F.greatest(k, (F.coalesce("new", F.lit("")) == k).cast("double")).alias(k) for k in KINDS))
        contexts = state.groupBy("context").agg(F.count("*").alias("n"), *(F.sum(total(k)).alias(k) for k in KINDS))
        scored = contexts.select("context", *((F.col(k) / (F.col("n") + doubt)).alias(f"c_{k}") for k in KINDS))
        scored = cuts.write(scored.filter(reduce(lambda a, b: a | b, (F.col(f"c_{k}") >= confident for k in KINDS))))
        # a token is of a kind unless all its confident contexts err
        sure = lambda k: F.when(F.col(f"c_{k}") >= confident, F.col(f"c_{k}")).otherwise(0.0)
        tokens = edges.filter("not form").join(scored, "context").groupBy("token").agg(*((1 - F.exp(F.sum(F.log1p(-sure(k))))).alias(k) for k in KINDS))
        best = F.array_max(F.array(*(F.struct(F.col(k).alias("p"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS))))
        new = cuts.write(tokens.select("token", best.alias("best")).filter(F.col("best.p") >= confident).select("token", "best.kind"))
        count = new.count()
        if count == known:
            return new
        found, known = new, count


def personal_data(docs: DataFrame, cuts: Cuts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds personal data in whole texts.

    Returns one row for each input row: id, mark (hash of the text), base and
    spans: arrays of (start, kind, end), ordered, in code points with the end
    exclusive; base holds what is found by form, spans also what contexts
    discover. A null text counts as empty. Rows with null or repeated ids
    are searched like any other. Other columns are not read. Discovered
    spans never overlap those found by form.
    """
    found, more = _found(docs, cuts, id_col, text_col)
    both = found.join(more, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("mark") == F.col("more_mark")), "left")
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "more")))
    return both.select("id", "mark", F.col("spans").alias("base"), spans.alias("spans"))


def _mark(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _found(docs: DataFrame, cuts: Cuts, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The scan of docs, and (more_id, more_mark, more) of the texts in which contexts discover spans, a row for each text."""
    found = cuts.write(scan(docs.select(F.col(id_col).alias("id"), _mark(text_col).alias("mark"), F.col(text_col).alias("text"))))
    each = found.filter(F.size("mentions") > 0).select("id", "mark", F.explode("mentions").alias("m")).select("id", "mark", "m.*")
    kinds = [F.max((F.coalesce("kind", F.lit("")) == k).cast("double")).alias(k) for k in KINDS]
    pairs = each.select(F.explode("contexts").alias("context"), "token", "kind")
    edges = cuts.write(pairs.groupBy("context", "token").agg(F.max(F.col("kind").isNotNull()).alias("form"), *kinds))
    new = discover(edges, cuts)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("known")).cast("int") - 1
    # equal rows get the same spans
    more = each.filter("kind is null").join(new.withColumnRenamed("kind", "known"), "token")
    more = more.groupBy(F.col("id").alias("more_id"), F.col("mark").alias("more_mark")).agg(F.sort_array(F.collect_set(F.struct("start", order.alias("kind"), "end"))).alias("more"))
    return found, cuts.write(more)


def as_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (start, kind, end) replaced by its kind in brackets; overlapping spans become one of the first's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data replaced in text_col and all other columns as they are; null texts stay null.

    Spans by form are found and replaced in one narrow pass. Only where
    contexts discover any do documents meet a table of those, by id and hash
    of the text.
    """
    _, more = _found(docs, Cuts(docs.sparkSession, "redaction"), id_col, text_col)
    columns = docs.columns
    more_col, found_id, found_mark = (unused(n, columns) for n in ("more", "found_id", "found_mark"))

    @F.arrow_udf("string")
    def replace(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, more in batches:
            more = more.to_pylist()
            whole = ((t.decode(), m) if t is not None else (None, m) for t, m in zip(texts_of(texts), more))
            yield pa.array([t and redact(t, base_spans(t) + [(s["start"], s["kind"], s["end"]) for s in m or []]) for t, m in whole], pa.string())

    span_type = dict(more.dtypes)["more"]
    if more.isEmpty():
        met = docs.withColumn(more_col, F.lit(None).cast(span_type))
    else:
        more = more.select(F.col("more_id").alias(found_id), F.col("more_mark").alias(found_mark), F.col("more").alias(more_col))
        met = docs.join(more, F.col(id_col).eqNullSafe(F.col(found_id)) & (_mark(text_col) == F.col(found_mark)), "left")
    return met.withColumn(text_col, replace(text_col, more_col)).select(columns)


def op9_personal_data(spark, sf_dir):
    found = personal_data(read(spark, sf_dir, "documents"), Cuts(spark, "personal-data"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
