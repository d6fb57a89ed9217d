"""Personal data: patterns, and terms that disclose what the patterns protect.

What the patterns find are the protected entities. How strongly a term reveals one is
estimated from the corpus: the share of the term's texts that hold the entity, as a lower
confidence bound, so that few texts prove little. It says how little uncertainty the term
leaves (its logarithm in bits), and does not depend on the size of the corpus. Beyond the
thresholds a term is removed or generalised too, wherever in the corpus it stands.
Different texts are counted, not copies.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import bit_table, in_batches, in_table, unused_name
from purchase_insights.sources.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("remove", "generalise")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A digit or plus and all that follows of what the numeric kinds are made of.
NUMERIC = re.compile(r"[0-9+][0-9+ ().-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{3,}")
NOT_DIGIT = re.compile(r"[^0-9]+")
COUNTED_AT_ONCE = 100_000
KNOWN_TERMS = 300_000
#: Quantile of the normal distribution for the confidence bound: 95 % on one side.
Z = 1.645


def _luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in ``KINDS``, then start.

    Matches are leftmost and non-overlapping within a kind; one that fails its check
    is dropped. Every pattern takes time in proportion to the text.
    """
    found: dict[str, list[tuple[str, int, int]]] = {kind: [] for kind in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found["email"].append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for run in NUMERIC.finditer(text):
        start, end = run.span()
        for match in IP.finditer(text, start, end):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
                found["ip"].append(("ip", *match.span()))
        for match in CARD.finditer(text, start, end):
            digits = NOT_DIGIT.sub("", match[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(("card", *match.span()))
        for match in PHONE.finditer(text, start, end):
            if 9 <= len(NOT_DIGIT.sub("", match[0])) <= 15:
                found["phone"].append(("phone", *match.span()))
    return [span for kind in KINDS for span in found[kind]]


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """The different entities of a text: a hash of the kind and the value without punctuation."""
    found = set()
    for kind, start, end in spans:
        value = text[start:end].lower() if kind in ("email", "ip") else NOT_DIGIT.sub("", text[start:end])
        found.add(xxhash.xxh64_intdigest(f"{kind}:{value}") >> 1)
    return sorted(found)


class _Chosen(dict):
    """Lower-case forms of the terms that a table of bits lets through, None for others; forgets all when it is full."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def __missing__(self, word: str) -> str | None:
        if len(self) >= KNOWN_TERMS:
            self.clear()
        term = word.lower()
        chosen = self.bits is None or in_table(self.bits, xxhash.xxh64_intdigest(term, 42))
        found = self[word] = term if chosen else None
        return found


def uncovered_terms(text: str, spans: list[tuple[str, int, int]], chosen: _Chosen) -> dict[str, list[tuple[int, int]]]:
    """Where each of the chosen terms of a text stands, without what overlaps a span."""
    covered = sorted((start, end) for _, start, end in spans)
    found, k, latest = defaultdict(list), 0, 0
    for match in TERM.finditer(text):
        a, b = match.span()
        while k < len(covered) and covered[k][0] < b:
            latest = max(latest, covered[k][1])
            k += 1
        if latest <= a and (term := chosen[match[0]]) is not None:
            found[term].append((a, b))
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SPAN = "struct<kind: string, start: int, end: int>"


def _detect(docs: DataFrame) -> DataFrame:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _Chosen(None)
        for batch in batches:
            spans, named, terms = [], [], []
            for value in batch["text"]:
                text = value.as_py() or ""
                found = base_spans(text)
                spans.append(found)
                named.append(entities(text, found))
                terms.append(list(uncovered_terms(text, found, every)) if found else [])
            counts = [[sum(s[0] == kind for s in found) for found in spans] for kind in KINDS]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                **{f"n_{kind}": pa.array(n, pa.int64()) for kind, n in zip(KINDS, counts)},
                "base_sha256": pa.array([hashlib.sha256(_joined(found).encode()).hexdigest() for found in spans]),
                "base": pa.array([[dict(zip(("kind", "start", "end"), s)) for s in found] for found in spans], pa.list_(span)),
                "entities": pa.array(named, pa.list_(pa.int64())),
                "terms": pa.array(terms, pa.list_(pa.string())),
            })

    schema = (
        "doc_id bigint, text_hash bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        f"base_sha256 string, base array<{SPAN}>, entities array<bigint>, terms array<string>"
    )
    source = in_batches(docs).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(detect, schema)


def confidence(n_both: Column, n_term: Column) -> Column:
    """Lower confidence bound (Wilson's) of a share, from how often it was seen."""
    n, share, z2 = n_term.cast("double"), n_both / n_term, Z * Z
    middle = share + z2 / (2 * n)
    return (middle - Z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _together(found: DataFrame, min_documents: int, least: float) -> DataFrame:
    """term, n_entity, n_both: terms and entities that stand in ``min_documents`` texts together, wherever in them.

    Left out are terms that the texts with an entity alone show to stay below the
    confidence ``least``. Entities of the same texts count as one: the many of a page and its near copies
    make no pair each.
    """
    of_text = found.select("text_hash", F.explode("entities").alias("entity")).distinct()
    texts = (F.bit_xor(F.xxhash64("text_hash", F.lit(k))).alias(f"texts_{k}") for k in range(2))
    named = of_text.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *texts)
    named = named.where(F.col("n_entity") >= min_documents)
    group = F.struct("n_entity", "texts_0", "texts_1").alias("group")
    of_text = materialize(of_text.join(named, "entity").select("text_hash", group).distinct(), "entities")
    if of_text.isEmpty():
        return of_text.select(F.lit("").alias("term"), "group.n_entity", F.lit(0).cast("bigint").alias("n_both"))
    held = found.select("text_hash", F.explode("terms").alias("term"))
    held = held.join(of_text.select("text_hash").distinct(), "text_hash", "left_semi").distinct()
    held = materialize(held, "entity-terms")
    seen = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_seen")).where(F.col("n_seen") >= min_documents)
    likely = (F.col("n_seen") * least <= F.col("group.n_entity")) & (F.col("n_seen") >= min_documents)
    pairs = held.join(seen, "term").join(of_text, "text_hash").where(likely)
    counted = pairs.groupBy("group", "term", "n_seen").agg(F.count(F.lit(1)).alias("n_both"))
    counted = counted.where((F.col("n_both") >= min_documents) & (confidence(F.col("n_both"), F.col("n_seen")) >= least))
    return counted.select("term", "group.n_entity", "n_both")


def _text_counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """term, n_term: in how many different texts of the corpus a term of the table stands."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _Chosen(bits)
        for batch in batches:
            rows, terms = [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                of_text = {term for word in set(TERM.findall(text or "")) if (term := chosen[word]) is not None}
                rows += [row] * len(of_text)
                terms += of_text
            hashes = batch["text_hash"].take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([hashes, pa.array(terms, pa.string())], ["text_hash", "term"])

    texts = in_batches(docs).select("text", F.xxhash64("text").alias("text_hash"))
    found = texts.mapInArrow(find, "text_hash bigint, term string").distinct()
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing_terms(
    docs: DataFrame, found: DataFrame, n_texts: int, generalise_from: float, min_documents: int, least_bits: float
) -> DataFrame:
    """term and strength of the terms that disclose an entity, the largest over all entities."""
    together = materialize(_together(found, min_documents, generalise_from), "terms-with-entities")
    if together.isEmpty():
        return together.select("term", F.lit(0.0).alias("strength"))
    bits = bit_table(together.select(F.xxhash64("term").alias("hash")), "hash")
    strength = confidence(F.col("n_both"), F.col("n_term"))
    mutual = F.log2(F.lit(float(n_texts)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    strong = together.join(_text_counts(docs, bits), "term").where(mutual >= least_bits)
    strongest = strong.groupBy("term").agg(F.max(strength).alias("strength"))
    return materialize(strongest.where(F.col("strength") >= generalise_from), "disclosing-terms")


def _marks(docs: DataFrame, disclosing: DataFrame, remove_from: float) -> DataFrame:
    """marked_doc, marked_hash, marks: every occurrence of the disclosing terms, the removed ones first."""
    bits = bit_table(disclosing.select(F.xxhash64("term").alias("hash")), "hash")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _Chosen(bits)
        for batch in batches:
            rows, terms, starts, ends = [], [], [], []

            def listed() -> pa.RecordBatch:
                taken = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_pydict({
                    "marked_doc": batch["doc_id"].take(taken),
                    "marked_hash": batch["text_hash"].take(taken),
                    "term": pa.array(terms, pa.string()),
                    "starts": pa.array(starts, pa.list_(pa.int32())),
                    "ends": pa.array(ends, pa.list_(pa.int32())),
                })
                for column in (rows, terms, starts, ends):
                    column.clear()
                return out

            for row, value in enumerate(batch["text"]):
                text = value.as_py() or ""
                if not any(chosen[word] is not None for word in set(TERM.findall(text))):
                    continue
                for term, places in uncovered_terms(text, base_spans(text), chosen).items():
                    rows.append(row)
                    terms.append(term)
                    starts.append([a for a, _ in places])
                    ends.append([b for _, b in places])
                if len(rows) > COUNTED_AT_ONCE:
                    yield listed()
            yield listed()

    source = in_batches(docs).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "marked_doc bigint, marked_hash bigint, term string, starts array<int>, ends array<int>"
    places = source.mapInArrow(find, schema).join(disclosing, "term")
    places = places.select("marked_doc", "marked_hash", "strength", F.explode(F.arrays_zip("starts", "ends")).alias("at"))
    later = F.col("strength") < remove_from
    kind = F.when(later, "generalise").otherwise("remove")
    order = F.struct(later.alias("later"), F.col("at.starts").alias("start"), F.col("at.ends").alias("end"), kind.alias("kind"))
    of_row = places.groupBy("marked_doc", "marked_hash").agg(F.sort_array(F.collect_set(order)).alias("marks"))
    as_spans = F.transform("marks", lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return of_row.select("marked_doc", "marked_hash", as_spans.alias("marks"))


def personal_data(
    docs: DataFrame,
    remove_from: float = 0.75,
    generalise_from: float = 0.5,
    min_documents: int = 3,
    least_bits: float = 2.0,
) -> DataFrame:
    """Personal data of each row of ``docs`` (doc_id, text).

    Columns: doc_id, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, and spans,
    an array of (kind, start, end) in code points: those of the patterns by kind, then
    terms to ``remove`` and to ``generalise``. A term counts as disclosing if at least
    ``min_documents`` different texts hold it and an entity, ``least_bits`` of information
    on the entity come with it (it is not just a common one), and its strength (see
    above), the largest over all entities, reaches a threshold: 0.5 leaves one bit of
    uncertainty. It is then marked wherever it stands in any document, unless it overlaps a
    span of the patterns. Statistics are taken over all texts, equal ones once. A missing
    text is empty and has no spans; repeated rows are repeated; other columns are ignored.
    """
    found = materialize(_detect(docs), "personal-data")
    kept = [c for c in found.columns if c not in ("base", "entities", "terms")]
    without_terms = found.select(*kept, F.col("base").alias("spans"))
    n_texts = found.select("text_hash").distinct().count()
    disclosing = disclosing_terms(docs, found, n_texts, generalise_from, min_documents, least_bits)
    if disclosing.isEmpty():
        return without_terms
    marks = _marks(docs, disclosing, remove_from)
    same = found["doc_id"].eqNullSafe(marks["marked_doc"]) & (found["text_hash"] == marks["marked_hash"])
    none = F.array().cast(f"array<{SPAN}>")
    return found.join(marks, same, "left").select(*kept, F.concat("base", F.coalesce("marks", none)).alias("spans"))


def span_text(spans: str = "spans"):
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _rewrite(text: str, spans: list[dict]) -> str:
    """Patterns become marks, removed terms go, generalised ones keep three letters."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        start, end, kind = span["start"], span["end"], span["kind"]
        if start < at:  # inside what an earlier span covers, or reaching out of it
            at = max(at, end)
            continue
        out.append(text[at:start])
        out.append({"remove": "", "generalise": f"{text[start : start + 3]}*"}.get(kind, f"[{kind.upper()}]"))
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with personal data replaced; all columns stay, n_chars (if any) is counted anew.

    Rows without personal data are unchanged. Rows are matched by doc_id and a hash of
    the text, so repeated and missing ids are safe.
    """
    spans = personal_data(docs, **thresholds).where(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("span_doc"), F.col("text_hash").alias("span_hash"), "spans")
    spans = materialize(spans.dropDuplicates(["span_doc", "span_hash"]), "spans")
    same = docs["doc_id"].eqNullSafe(spans["span_doc"]) & (F.xxhash64(docs["text"]) == spans["span_hash"])
    columns, schema = docs.columns, docs.schema
    name = unused_name("spans", docs)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch[name].to_pylist()
            texts = [t if not s else _rewrite(t, s) for t, s in zip(batch["text"].to_pylist(), found)]
            out = {column: batch[column] for column in columns}
            out["text"] = pa.array(texts, batch["text"].type)
            if "n_chars" in out:
                counted = pa.array([len(t) if s else None for t, s in zip(texts, found)], batch["n_chars"].type)
                out["n_chars"] = pc.coalesce(counted, batch["n_chars"])
            yield pa.RecordBatch.from_pydict(out)

    joined = in_batches(docs).join(spans, same, "left").select(*(docs[c] for c in columns), spans["spans"].alias(name))
    return joined.mapInArrow(rewrite, schema)
