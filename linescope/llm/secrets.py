"""Secret scans: fixed patterns, and random strings shown by the few characters they give a token.

Prose, code and identifiers compress well under a byte-pair vocabulary; keys and passwords do not. Runs of key-like
characters are encoded with tiktoken, and those with few characters a token are reported, after digests of known
lengths, UUIDs and identifiers are excluded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linescope.llm import tokens

#: Kinds in the order in which spans with one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: A text without any of these, in lower case, has no assignment.
NAMES = ("passw", "secret", "token", "api")
#: What may be a key; what of it is a known digest; and the parts of snake, kebab or camel case.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})=*", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Characters a token below which a candidate counts as random.
RATIO = 2.1


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("linescope", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost without overlap for each kind, in code points."""
    found = []
    lowered = text.lower()
    if any(n in lowered for n in NAMES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def identifier(s: str, encoding, ratio: float = RATIO) -> bool:
    """Whether a candidate is made of words: mostly letters, and its parts in lower case have ``ratio`` characters a token.

    A part counts as it does at the start of a text or behind a space, whichever takes fewer tokens.
    """
    words = [p.lower() for p in PART.findall(s)]
    letters, digits = sum(map(len, words)), sum(map(str.isdigit, s))
    if digits * 2 >= letters:
        return False
    return letters >= ratio * sum(min(len(encoding.encode_ordinary(w)), len(encoding.encode_ordinary(f" {w}"))) for w in words)


def random_spans(text: str, encoding, ratio: float = RATIO) -> list[tuple[int, str, int]]:
    """(start, "random", end) of candidates with under ``ratio`` characters a token."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if DIGEST.fullmatch(s) or UUID.fullmatch(s) or not any(map(str.isalnum, s)):
            continue
        if len(s) < ratio * len(encoding.encode_ordinary(s)) and not identifier(s, encoding, ratio):
            found.append((m.start(), "random", m.end()))
    return found


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def scan(docs: DataFrame, ratio: float = RATIO, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_random``.

    Spans are ``kind:start:end`` in code points with an exclusive end, by start, joined by commas. ``base_sha256`` is
    that of the fixed patterns' spans. A random string that touches one of those is not listed again. Null texts are
    empty: counts of 0 and the digest of the empty string. Only key and text are read.
    """
    vocabulary = vocabulary or tokens.default_vocabulary("byte_bpe_50k.tiktoken")
    fields = [(key, docs.schema[key].dataType)] + [(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    fields += [("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_random", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def find(batches):
        encoding = _encoding(vocabulary)
        for b in (s for batch in batches for s in tokens.slices(batch, 1)):
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                more = [x for x in random_spans(t or "", encoding, ratio) if all(x[2] <= s or e <= x[0] for s, _, e in base)]
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            columns = [pa.array(c, T_ARROW[f[1].typeName()]) for c, f in zip(zip(*rows), fields[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return docs.select(key, text).mapInArrow(find, schema)


T_ARROW = {"long": pa.int64(), "string": pa.string()}
