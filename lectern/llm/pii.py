"""Personal data: base patterns, and terms that disclose a protected entity.

A base span stands for two entities: its normalised value, and the part of it that it
shares with others (mail domain, network of an address, first digits of a number). Terms
are words of four or more letters within ``reach`` characters of an occurrence. With N
documents, n_e of them with the entity, n_t with the term, n_et with the term near the
entity, and k different texts among these,

    disclosure = log(N * n_et / (n_e * n_t)) / log(N / n_e) * k / (k + support)

is the pointwise mutual information as a share of the entity's information, 1 when the
term is found nowhere but with the entity, smoothed by how many texts say so. Terms at or
above ``generalise`` for any entity become ``[GENERALISED]``, at or above ``remove`` they
are removed, wherever they stand: also in documents without the entity, which they would
give away. All counts cover the whole input.

Defined results: null and empty texts give no spans and stay as they are; equal rows
count as one co-occurrence and get equal spans; when every document has the entity its
information is zero and nothing is disclosed; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common

# The base patterns. A match starts at the start of a run or right after
# the match before it, so that long runs are not tried from each of their characters.
PATTERNS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{4,}"
ACTIONS = ["generalised", "removed"]

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Disclosure:
    """Thresholds of the information-theoretic part."""

    generalise: float = 0.6
    remove: float = 0.8
    support: float = 1.0
    reach: int = 60


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$"),
        "card": F.length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def find(docs: DataFrame) -> DataFrame:
    """Add ``pii``: the base spans as ``struct<start, rank, end, kind, text>``, sorted by place."""
    df = docs.withColumn("__llm_text", common.text_of(docs))
    df = common.with_spans(df, "__llm_text", PATTERNS)
    for kind in PATTERNS:
        df = df.withColumn(f"__llm_{kind}", F.filter(f"__llm_{kind}", _keep(kind)))
    spans = F.concat(*[common.labelled(f"__llm_{k}", k, r) for r, k in enumerate(PATTERNS)])
    return df.withColumn("pii", F.array_sort(spans)).drop("__llm_text", *[f"__llm_{k}" for k in PATTERNS])


def _keep(kind: str):
    return lambda span: _valid(kind, span["text"])


def _row_key(docs: DataFrame) -> DataFrame:
    """Hashes that name a text and a row: document ids may be null or repeated."""
    text = common.text_of(docs)
    return docs.withColumns(
        {"__llm_hash": F.xxhash64(text), "__llm_row": F.xxhash64(F.col("doc_id").cast("string"), text)}
    )


def contexts(found: DataFrame, reach: int) -> DataFrame:
    """Add ``__llm_near``: per base span its entities and the text on both sides of it."""
    return found.withColumn(
        "__llm_near",
        F.expr(
            f"""transform(pii, s -> named_struct(
              'entities', array(
                xxhash64(s.kind, CASE s.kind WHEN 'email' THEN lower(s.text)
                                 WHEN 'ip' THEN s.text ELSE regexp_replace(s.text, '[^0-9]', '') END),
                xxhash64(s.kind, 'part', CASE s.kind WHEN 'email' THEN lower(substring_index(s.text, '@', -1))
                                         WHEN 'ip' THEN substring_index(s.text, '.', 3)
                                         ELSE left(regexp_replace(s.text, '[^0-9]', ''), 6) END)),
              'at', array(greatest(s.start - {reach}, 0), s.end),
              'side', array(
                substring(coalesce(text, ''), greatest(s.start - {reach}, 0) + 1, s.start - greatest(s.start - {reach}, 0)),
                substring(coalesce(text, ''), s.end + 1, {reach}))))"""
        ),
    )


def occurrences(found: DataFrame, reach: int) -> DataFrame:
    """One row per term near an entity: ``__llm_hash``, ``__llm_row``, entity, term.

    Words that the window cuts, or that are part of a base span, do not count.
    """
    near = found.where(F.size("__llm_near") > 0).select(
        "doc_id", "__llm_hash", "__llm_row", "pii", F.explode("__llm_near").alias("n")
    )
    sides = near.select(
        "doc_id", "__llm_hash", "__llm_row", "pii", F.col("n.entities").alias("entities"),
        F.posexplode(F.arrays_zip(F.col("n.at").alias("at"), F.col("n.side").alias("side"))).alias("__llm_pos", "z"),
    ).select(
        "doc_id", "__llm_hash", "__llm_row", "pii", "entities", "__llm_pos",
        F.col("z.at").alias("at"), F.col("z.side").alias("side"),
    )
    terms = common.with_spans(sides, "side", {"term": TERM}).select(
        "*", F.explode("__llm_term").alias("t")
    )
    cut = F.when(F.col("__llm_pos") == 0, (F.col("t.start") == 0) & (F.col("at") > 0)).otherwise(
        (F.col("t.end") == F.length("side")) & (F.length("side") == reach)
    )
    return (
        terms.where(~cut)
        .withColumns({"start": F.col("at") + F.col("t.start"), "end": F.col("at") + F.col("t.end")})
        .where(F.expr("NOT exists(pii, b -> b.start < end AND start < b.end)"))
        .select("__llm_hash", "__llm_row", F.explode("entities").alias("entity"), F.xxhash64(F.lower("t.text")).alias("term"))
    )


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents per term, for the given distinct terms, over all documents.

    Counted before the join: a frequent term is one row per task then, while joining the
    words of all documents first would carry each of its occurrences.
    """
    words = F.transform(F.regexp_extract_all(common.text_of(docs), F.lit(TERM), F.lit(0)), F.lower)
    held = docs.select(F.explode(F.array_distinct(words)).alias("word")).select(F.xxhash64("word").alias("term"))
    return held.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")


def disclosing(docs: DataFrame, near: DataFrame, rules: Disclosure) -> DataFrame:
    """Pairs (entity, term) at or above a threshold, with ``disclosure`` and ``action``.

    The documents with a term near any entity are no more than all with the term, so
    they bound the disclosure from above: only pairs that can reach the threshold have
    their terms counted over the whole input.
    """
    per_text = near.groupBy("entity", "term", "__llm_hash").agg(F.countDistinct("__llm_row").alias("n"))
    # No disclosure is above its smoothing: pairs of too few texts go before any join.
    smoothing = F.col("n_texts") / (F.col("n_texts") + rules.support)
    pairs = (
        per_text.groupBy("entity", "term")
        .agg(F.sum("n").alias("n_et"), F.count("*").alias("n_texts"))
        .where(smoothing >= rules.generalise)
    )
    entities = (
        near.select("entity", "__llm_row").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    )
    local = near.select("term", "__llm_row").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    total = docs.agg(F.count("*").alias("n_all"))

    def share(n_t: str) -> Column:
        return smoothing * F.ln(F.col("n_all") * F.col("n_et") / (F.col("n_e") * F.col(n_t))) / F.ln(
            F.nullif(F.col("n_all") / F.col("n_e"), F.lit(1.0))
        )

    possible = common.stage(
        pairs.join(local, "term").join(entities, "entity").join(F.broadcast(total))
        .where(share("n_near") >= rules.generalise),
        "pii-pairs",
    )
    return (
        possible.join(document_counts(docs, possible.select("term").distinct()), "term")
        .withColumn("disclosure", share("n_t"))
        .where(F.col("disclosure") >= rules.generalise)
        .select(
            "entity", "term", "disclosure",
            F.when(F.col("disclosure") >= rules.remove, 1).otherwise(0).alias("action"),
        )
    )


def term_hits(docs: DataFrame, found: DataFrame, rules: Disclosure) -> DataFrame:
    """Per (doc_id, text) with disclosing terms: ``__llm_hits``, these terms and their actions."""
    near = common.stage(occurrences(found, rules.reach), "pii-near")
    flagged = disclosing(docs, near, rules).groupBy("term").agg(F.max("action").alias("action"))
    flagged = common.stage(flagged, "pii-terms")
    if flagged.count() <= BROADCAST_ROWS:
        flagged = F.broadcast(flagged)
    keyed = _row_key(docs.select("doc_id", "text"))
    words = F.transform(F.regexp_extract_all(common.text_of(keyed), F.lit(TERM), F.lit(0)), F.lower)
    held = keyed.select("doc_id", "__llm_hash", F.explode(F.array_distinct(words)).alias("word"))
    met = held.select("doc_id", "__llm_hash", F.xxhash64("word").alias("term")).join(flagged, "term")
    hits = met.groupBy("doc_id", "__llm_hash").agg(F.collect_set(F.struct("term", "action")).alias("__llm_hits"))
    return common.stage(hits, "pii-hits")


#: Terms or documents with terms up to which their table is sent to all executors.
BROADCAST_ROWS = 200_000


def _with_terms(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the spans of the disclosing terms to ``pii``; spans inside base spans stay out."""
    named = hits.withColumnsRenamed({"doc_id": "__llm_id", "__llm_hash": "__llm_h"})
    if hits.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    on = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_hash") == F.col("__llm_h"))
    # Only texts with a term are searched for words.
    searched = F.when(F.col("__llm_hits").isNotNull(), common.text_of(found)).otherwise("")
    df = common.with_spans(found.join(named, on, "left").withColumn("__llm_said", searched), "__llm_said", {"word": TERM})
    kinds = ", ".join(f"'{a}'" for a in ACTIONS)
    spans = F.expr(
        f"""transform(filter(transform(__llm_word, w -> named_struct(
              'w', w, 'a', array_max(transform(filter(__llm_hits, h -> h.term = xxhash64(lower(w.text))), h -> h.action)))),
            x -> x.a IS NOT NULL AND NOT exists(pii, b -> b.start < x.w.end AND x.w.start < b.end)),
          x -> named_struct('start', x.w.start, 'rank', x.a + {len(PATTERNS)}, 'end', x.w.end,
                            'kind', element_at(array({kinds}), x.a + 1), 'text', x.w.text))"""
    )
    both = F.when(F.col("__llm_hits").isNull(), F.col("pii")).otherwise(F.array_sort(F.concat("pii", spans)))
    return df.withColumn("pii", both).drop("__llm_id", "__llm_h", "__llm_hits", "__llm_said", "__llm_word")


def _inventory(docs: DataFrame, rules: Disclosure) -> DataFrame:
    """All rows without their texts: keys, base spans and contexts, written once."""
    found = contexts(find(_row_key(docs.select("doc_id", "text"))), rules.reach)
    return common.stage(found.drop("text"), "pii-found")


def scan(docs: DataFrame, rules: Disclosure | None = None) -> DataFrame:
    """Per row: ``doc_id`` and ``pii``, all spans sorted by place."""
    rules = rules or Disclosure()
    hits = term_hits(docs, _inventory(docs, rules), rules)
    found = find(_row_key(docs.select("doc_id", "text")))
    return _with_terms(found, hits).select("doc_id", "pii")


def sanitise(docs: DataFrame, rules: Disclosure | None = None) -> DataFrame:
    """The documents with personal data and disclosing terms taken out of ``text``.

    Rows stay where they are while the table of documents with terms can be sent to them.
    """
    rules = rules or Disclosure()
    hits = term_hits(docs, _inventory(docs, rules), rules)
    found = _with_terms(find(_row_key(common.packed(docs, "doc_id", "text"))), hits)
    text = F.when(F.size("pii") > 0, common.redacted("text", "pii")).otherwise(F.col("text"))
    return common.unpacked(found.withColumn("text", text), docs.columns, text="text")


def op3(spark, sf) -> DataFrame:
    df = scan(common.documents(spark, sf))
    df = df.withColumn("__llm_base", F.filter("pii", lambda s: s["rank"] < len(PATTERNS)))
    return df.select(
        "doc_id",
        *[common.kind_count("__llm_base", k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(common.span_list("__llm_base"), 256).alias("base_sha256"),
        common.span_list("pii").alias("spans"),
    )
