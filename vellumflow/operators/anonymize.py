"""Pseudonymisation of texts and pages with tokens that are the same throughout a run.

Phones and e-mail addresses are numbered by first appearance: document order, then place in the text. The dictionary is built
from distinct keys, so numbering sorts keys, not documents. Names found after a label are replaced in later documents
(``cumulative``) or in all (``global``); which names can occur in a document is found by an equality join on keys of
neighbouring words, so the names of a large corpus are never applied to every text nor brought to the driver. They are then put
in place by position. Texts that have nothing replaced but national identifiers are not shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import names as N
from ..functions import pii
from ..functions.regex import bind, matches, rewrite
from ..plans.marks import bit_table, bits_for, free_prefix, mark
from ..plans.ranking import number_rows
from ..plans.scratch import materialize
from .dictionary import Dictionary

EMAIL_STUB = "[EMAIL_0]"
PREFIXES = {"email": "EMAIL", "tel": "TEL"}


def first_seen(found: DataFrame, key: str = "key", order: str = "at") -> DataFrame:
    """(key, n): distinct keys numbered by their first place."""
    firsts = found.groupBy(key).agg(F.min(order).alias(order))
    return number_rows(firsts, F.col(order), tag="first-seen").select(key, "n")


def text_parts(text: Column, markup: bool) -> Column:
    """The parts of a text in which identifiers are replaced."""
    return F.filter(H.segments(text), H.is_text) if markup else F.array(text)


def without_emails(part: Column) -> Column:
    return F.when(part.contains(pii.EMAIL_HINT), F.regexp_replace(part, pii.EMAIL, F.lit(EMAIL_STUB))).otherwise(part)


def email_matches(parts: Column) -> Column:
    def keys(part: Column) -> Column:
        return F.when(part.contains(pii.EMAIL_HINT), F.transform(matches(part, pii.EMAIL), pii.email_key)).otherwise(_no_keys())

    return F.flatten(F.transform(parts, keys))


def phone_matches(parts: Column) -> Column:
    """Keys of phones in the text as it is after e-mail addresses and national identifiers have been replaced."""
    def keys(part: Column) -> Column:
        found = bind(pii.rewrite_national_ids(without_emails(part)), lambda left: F.transform(matches(left, pii.PHONE), pii.phone_key))
        return F.when(part.rlike(pii.PHONE_HINT), found).otherwise(_no_keys())

    return F.flatten(F.transform(parts, keys))


def national_ids(parts: Column) -> Column:
    counts = F.transform(parts, lambda p: bind(without_emails(p), pii.count_national_ids))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def identifier_keys(docs: DataFrame, order: str, text: str, markup: bool) -> DataFrame:
    """(order, email, tel, cedulas) of the documents that hold any: keys in the order of the text, and the number of national identifiers.

    Texts without an at sign or a digit are not looked at any further, and the parts of the others are cut once.
    """
    some = docs.where(F.col(text).rlike("@|\\d{3}"))
    parts = some.select(order, text_parts(F.col(text), markup).alias("_parts"))
    found = parts.select(order, email_matches(F.col("_parts")).alias("email"), phone_matches(F.col("_parts")).alias("tel"), national_ids(F.col("_parts")).alias("cedulas"))
    return found.where("size(email) > 0 or size(tel) > 0 or cedulas > 0")


def key_places(found: DataFrame, order: str, kind: str) -> DataFrame:
    """(order, key, at) of every key of ``kind``, email or tel."""
    rows = found.select(order, F.posexplode(kind).alias("pos", "key"))
    return rows.select(order, "key", F.struct(F.col(order).alias("doc"), "pos").alias("at"))


def token_places(docs: DataFrame, order: str, text: str, kind: str) -> DataFrame:
    """(order, key, at) of every match of ``kind`` in a plain text: email or tel."""
    keys = {"email": email_matches, "tel": phone_matches}[kind](F.array(text))
    return key_places(docs.where(F.col(text).isNotNull()).select(order, keys.alias(kind)), order, kind)


def replace_from_dictionary(text: Column, pattern: str, key, table: Column, prefix: str) -> Column:
    """Replace matches by ``[PREFIX_n]`` with n from a map by key; a text without a map has no match."""
    new = rewrite(text, pattern, lambda m: F.concat(F.lit(f"[{prefix}_"), F.element_at(table, key(m)).cast("string"), F.lit("]")))
    return F.when(table.isNotNull(), new).otherwise(text)


@dataclass(frozen=True)
class Anonymized:
    docs: DataFrame  # the input's columns, text rewritten
    emails: DataFrame  # key, n
    phones: DataFrame  # key, n
    names: DataFrame  # name, n
    found: DataFrame  # _order, email, tel, cedulas: what each document with an identifier holds


def find_names(docs: DataFrame, order: str, text: str, *, seeds: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """(name, first, n): canonical names by first appearance; seeds come before all documents (first is null)."""
    spark = docs.sparkSession
    found = docs.select(F.col(order).alias("first"), F.posexplode(pii.extract_names(F.col(text), strict=strict)).alias("pos", "name"))
    if seeds:
        rows = spark.createDataFrame([(i, s) for i, s in enumerate(seeds)], "pos int, raw string")
        seed = rows.select(F.lit(None).cast(docs.schema[order].dataType).alias("first"), "pos", pii.normalize_name(F.col("raw")).alias("name"))
        found = found.unionByName(seed.where("name <> ''"))
    firsts = found.groupBy("name").agg(F.min(F.struct(F.col("first").isNotNull().alias("later"), "first", "pos")).alias("at"))
    return number_rows(firsts, F.col("at"), tag="names").select("name", F.col("at.first").alias("first"), "n")


def _names_over_batches(found: DataFrame, dictionary: Dictionary, batch: int) -> DataFrame:
    """(name, first, n) of this batch and earlier ones; ``first`` is null where a name comes before the batch."""
    places = found.select(F.col("name").alias("key"), F.col("n").alias("at"))
    numbered = dictionary.extend("name", places, batch).withColumnRenamed("key", "name")
    old = dictionary.known(found.sparkSession, "name", batch).select(F.col("key").alias("name"), F.lit(True).alias("_old"))
    own = found.select("name", "first")
    joined = numbered.join(own, "name", "left").join(old, "name", "left")
    return joined.select("name", F.when(F.col("_old").isNull(), F.col("first")).alias("first"), "n")


def names_by_document(parts: DataFrame, order: str, texts: str, names: DataFrame, scope: str) -> DataFrame:
    """(order, n, name) of the names that may occur in a document with an array of texts.

    Texts give up only keys that a table of bits, sized by the number of names, lets through, so few rows meet the names.
    """
    keyed = materialize(names.select("name", "first", "n", F.explode(N.name_hashes("name")).alias("hash")), "name-keys")
    table = parts.sparkSession.sparkContext.broadcast(bit_table(keyed.select("hash"), bits_for(keyed.count())))
    found = parts.select(order, F.explode(F.array_distinct(N.text_hashes(table)(F.col(texts)))).alias("hash"))
    hits = found.join(keyed, "hash")
    if scope == "cumulative":
        hits = hits.where(F.col("first").isNull() | (F.col("first") <= F.col(order)))
    elif scope != "global":
        raise ValueError("names_scope is 'global' or 'cumulative'")
    return hits.select(order, "n", "name").distinct()


def anonymize(
    docs: DataFrame,
    *,
    order: str,
    text: str,
    markup: bool,
    names: bool = True,
    seed_names: tuple[str, ...] = (),
    names_scope: str = "global",
    strict_labels: bool = False,
    dictionary: Dictionary | None = None,
    batch: int = 0,
) -> Anonymized:
    """Rewrite ``text``: header identifiers, e-mail addresses, national identifiers, phones, names, in this order.

    ``order`` is a unique key that gives the order of documents. With ``markup`` only text outside tags and raw zones is
    changed. Null text stays null.

    With a ``dictionary`` documents are one ``batch`` of many: keys and names of earlier batches keep their numbers and new ones
    come after them, so that batches in order get the tokens of one run; names of earlier batches are replaced in this one.

    Texts are read three times (identifiers, names, rewriting) and joined once, with what each document has to have replaced.
    """
    spark, at = docs.sparkSession, "_order"
    source = docs.withColumn(text, pii.rewrite_header_id(F.col(text))) if markup else docs
    narrow = [F.col(order).alias(at), F.col(text).alias("_text")]  # the caller's names may be any
    present = source.where(F.col(text).isNotNull()).select(*narrow)
    found = materialize(identifier_keys(present, at, "_text", markup), "identifiers")
    held = found.agg(*(F.coalesce(F.max(F.size(k)), F.lit(0)).alias(k) for k in PREFIXES)).first()
    tables = {k: spark.createDataFrame([], "key string, n long") for k in PREFIXES}
    # What is to be replaced: a row per document, kind and key.
    entries = [present.select(at, F.lit("").alias("kind"), F.lit("").alias("key"), F.lit(0).cast("long").alias("n")).limit(0)]
    for k in PREFIXES:
        if held[k] or dictionary is not None:
            places = key_places(found, at, k)
            tables[k] = materialize(first_seen(places), f"tokens-{k}") if dictionary is None else dictionary.extend(k, places, batch)
            entries.append(places.select(at, "key").distinct().join(tables[k], "key").select(at, F.lit(k).alias("kind"), "key", "n"))
    known = spark.createDataFrame([], "name string, first string, n long")
    if names:
        known = materialize(find_names(docs.where(F.col(text).isNotNull()).select(*narrow), at, "_text", seeds=seed_names, strict=strict_labels), "names")
        if dictionary is not None:
            known = materialize(_names_over_batches(known, dictionary, batch), "names-known")
        if not known.isEmpty():
            parts = present.select(at, text_parts(F.col("_text"), markup).alias("_parts"))
            entries.append(names_by_document(parts, at, "_parts", known, names_scope).select(at, F.lit("name").alias("kind"), F.col("name").alias("key"), "n"))
    rows = functools.reduce(DataFrame.unionByName, entries)

    def of(kind: str) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))

    columns = [F.map_from_entries(F.nullif(of(k), F.array().cast("array<struct<key:string,n:bigint>>"))).alias(f"_{k}") for k in PREFIXES]
    ordered = F.array_sort(F.transform(of("name"), lambda r: F.struct(r["n"].alias("n"), r["key"].alias("name"))))
    per = materialize(rows.groupBy(at).agg(*columns, F.transform(ordered, lambda r: r["name"]).alias("_names")), "replacements")
    start = free_prefix(source)
    per = per.withColumnsRenamed({c: start + c for c in per.columns})
    marked = mark(source, F.col(order), per.select(start + at), f"{start}marked")
    own = [F.col(f"`{c}`") for c in docs.columns]

    def change(part: Column) -> Column:
        def tel(p: Column) -> Column:
            return replace_from_dictionary(p, pii.PHONE, pii.phone_key, F.col(f"{start}_tel"), PREFIXES["tel"])

        return bind(replace_from_dictionary(part, pii.EMAIL, pii.email_key, F.col(f"{start}_email"), PREFIXES["email"]), lambda p: bind(pii.rewrite_national_ids(p), tel))

    def changed(ids: Callable[[Column], Column]) -> Column:
        return H.map_text(F.col(text), ids) if markup else ids(F.col(text))

    hinted = F.col(text).rlike(pii.CEDULA_HINT)
    clear = marked.where(f"not {start}marked").withColumn(text, F.when(hinted, changed(pii.rewrite_national_ids)).otherwise(F.col(text))).select(*own)
    met = marked.where(f"{start}marked").join(per, F.col(order) == F.col(start + at), "left")
    met = met.withColumn(text, F.when(F.col(start + at).isNotNull() | hinted, changed(change)).otherwise(F.col(text)))
    # Only texts with names go to Python.
    held = F.when(F.size(f"{start}_names") > 0, H.segments(F.col(text)) if markup else F.array(text))
    named = F.array_join(N.replace_names_in_parts(held, F.col(f"{start}_names"), F.lit(markup)), "")
    rewritten = clear.unionByName(met.withColumn(text, F.coalesce(named, F.col(text))).select(*own))
    return Anonymized(rewritten, tables["email"], tables["tel"], known, found)


def anonymizer_stats(result: Anonymized, *, with_names: bool = False) -> DataFrame:
    """One row: distinct phones and e-mail addresses, national identifiers found, number of names; names only when asked for."""
    ids = result.found.agg(F.coalesce(F.sum("cedulas"), F.lit(0)).cast("long").alias("cedulas"))
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((result.phones, "telephones"), (result.emails, "emails"), (result.names, "patient_names"))]
    for c in counts:
        ids = ids.crossJoin(c)  # one row each
    if with_names:
        ids = ids.crossJoin(result.names.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda r: r["name"]).alias("names")))
    return ids
