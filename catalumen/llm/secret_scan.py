"""Secret scans: keyword automaton first, anchored expressions at its hits, checksums last.

One Aho-Corasick automaton finds all keywords of a text in one pass. A rule's
regular expression is tried only at, or within a few characters after, a hit of
one of its keywords. Rules whose secrets embed a checksum keep a match only if
the checksum holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalumen.llm.base import query, row_slices, small_batches, table

# Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "iban", "card", "pem")
BASE_KINDS = KINDS[:3]

# Keywords of each kind, in lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "iban": ("iban",),
    "card": ("card", "visa", "mastercard"),
    "pem": ("-----begin",),
}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]{8,}")
RUN = re.compile(r"[A-Za-z0-9_-]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----")
# A number may follow its keyword within this many characters.
REACH = 24

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def crc62(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's body, as token issuers embed it."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def jwt_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


CHECKED = {
    "github": (GITHUB, lambda m: crc62(m[1]) == m[2]),
    "npm": (NPM, lambda m: crc62(m[1]) == m[2]),
    "jwt": (JWT, lambda m: jwt_header(m[1])),
    "pem": (PEM, lambda m: True),
}
NEAR = {
    "iban": (IBAN, lambda m: mod97(m[0].replace(" ", ""))),
    "card": (CARD, lambda m: luhn(re.sub("[^0-9]", "", m[0]))),
}


def automaton():
    """The keyword automaton; built once per task, since it does not travel with the job."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def number(text: str, kind: str, stop: int) -> re.Match | None:
    """The first number near a keyword that ends at ``stop`` whose checksum holds; whole ones before ones cut at a group."""
    pattern, valid = NEAR[kind]
    # The keyword may be part of a longer word; a number starts at a place where it can.
    whole = [m for i in range(stop, min(stop + REACH, len(text))) if not text[i - 1].isalnum() and (m := pattern.match(text, i))]
    shorter = (s for m in whole for end in range(m.end() - 1, m.start(), -1)
               if text[end] in " -" and (s := pattern.fullmatch(text, m.start(), end)))
    return next(filter(valid, chain(whole, shorter)), None)


def scan(text: str, keywords) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` of one text in code points, by start, then kind as listed."""
    # Lower-casing bytes touches A-Z only, so offsets stay those of the text.
    low = text.encode().lower().decode()
    hits: dict[str, list[tuple[int, int]]] = {}
    for last, (kind, n) in keywords.iter(low):
        hits.setdefault(kind, []).append((last + 1 - n, last + 1))
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, where in hits.items():
        where.sort()
        done = 0
        for start, stop in where:
            if start < done:
                continue
            if kind in NEAR:
                m = number(text, kind, stop)
                if m:
                    found.append((kind, *m.span()))
                    done = m.end()
                continue
            pattern, valid = {
                "assign": (ASSIGN, lambda m: len(m[2]) >= 12), "access": (ACCESS, lambda m: len(m[0]) >= 18),
            }.get(kind) or CHECKED[kind]
            m = pattern.match(text, start)
            if m:
                # A match that fails its test still uses up its characters.
                done = m.end()
                if valid(m):
                    found.append((kind, *m.span()))
            elif kind == "jwt" and text.startswith("eyJ", start):
                # What follows the run is the same for all hits in it.
                done = RUN.match(text, start).end()
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by one mark that names its first kind."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)`` for every row of ``docs``, in place and without a shuffle.

    ``spans`` lists (kind, start, end) in code points, end exclusive, by start,
    then kind. A null or empty text has no spans; a null or repeated key keeps
    its own row; other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in row_slices(batch, "text", 4 << 20):
                spans = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t or "", keywords)]
                         for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spans, kind)], ["key", "spans"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return found.withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """The same rows and columns with secrets cut out of ``text``; ``length``, if named, is counted anew.

    A null text stays null. Rows without secrets come back unchanged.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            for part in row_slices(batch, text, 4 << 20):
                at = part.schema.get_field_index(text)
                clean = [t if t is None or not (s := scan(t, keywords)) else redacted(t, s) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType)) if length else out


def span_text(spans, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(span_text(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))
