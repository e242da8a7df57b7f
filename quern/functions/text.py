"""Tokenisation and small string operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def simple_tokens(text: Column) -> Column:
    """ASCII word tokens: A-Z lowered, runs of [a-z0-9]. Only A-Z change case, so engines agree."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1))


def normalise_query(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalise_prefix(text: Column) -> Column:
    """As a query, but one trailing space stays: it says that the last word is complete."""
    return F.ltrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def strip_possessive(term: Column) -> Column:
    return F.regexp_replace(term, "['’＇][sS]$", "")


def correctable(word: Column) -> Column:
    """Letters only, 3 to 30 of them."""
    return word.rlike(r"^\p{L}{3,30}$")


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[A-Za-z0-9_-]{1,128}$"), F.lit(False))


def deletes(word: Column, prefix: int = 7) -> Column:
    """The word's first ``prefix`` characters with up to two characters deleted, without repeats."""
    head = F.substring(word, 1, prefix)
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(prefix))))
    some = F.when(F.length(head) > 0, one(head)).otherwise(F.array(F.lit("")))
    twice = F.flatten(F.transform(some, lambda w: F.when(F.length(w) > 0, one(w)).otherwise(F.array(w))))
    return F.array_distinct(F.concat(F.array(head), some, twice))


def tsv_safe(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\t\r\n]+", " "))


def shares(score: Column, total: Column) -> Column:
    return F.when(total != 0, score / total)


def instructed(query: Column, instruction: str, limit: int = 64) -> Column:
    """The instruction and the query's first ``limit`` white-space tokens: what a query encoder is given."""
    return F.concat(F.lit(instruction), F.array_join(F.slice(F.split(F.trim(query), r"\s+"), 1, limit), " "))


def utf16_offset(text: Column, at: Column) -> Column:
    """The UTF-16 offset of a UTF-8 byte offset that lies between characters."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at), "UTF-8")
    return F.length(F.encode(head, "UTF-16BE")) / 2


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ts: Column, *keys) -> Column:
    """A 26-character id that sorts by time: ten characters of the millisecond, sixteen of a hash of the keys."""
    letter = lambda bits: F.substring(F.lit(CROCKFORD), (bits % 32 + 1).cast("int"), F.lit(1))
    ms = F.unix_millis(ts)
    time = [letter(F.shiftright(ms, 5 * k)) for k in range(9, -1, -1)]
    hashes = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 4) for seed in (0, 1)]
    return F.concat(*time, *[letter(F.shiftright(h, 5 * k)) for h in hashes for k in range(8)])
