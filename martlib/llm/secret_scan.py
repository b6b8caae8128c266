"""Secret scan: keyword automaton, anchored expressions near its hits, then the checksum that a token carries.

Kinds, in the order used for ties:
  assign  `password = "..."` and its like, value of 8 characters or more
  access  AKIA and capitals or digits, 16 characters or more
  hex     a run of 32 or more lower-case hex digits
  github  ghp_ gho_ ghu_ ghs_ ghr_ and 36 characters, the last six being the CRC-32 of the 30 before them in base 62
  npm     npm_ and 36 characters with the same checksum
The first three are found without a checksum because they carry none. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import map_texts, read

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
#: The prefixes that the automaton looks for, in lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ANCHORED = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
#: Fixed value: digits of base 62, in order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
_HEX_ONE, _HEX_RUN = re.compile("[0-9a-f]"), re.compile("[0-9a-f]+")


def checksum62(body: str) -> str:
    """CRC-32 of body as six digits of base 62."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= MIN_ASSIGN
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    return checksum62(m[1]) == m[2]


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """A run of 32 holds a multiple-of-32 offset, so only hex digits at those offsets are looked at more closely."""
    found, done = [], 0
    for hit in _HEX_ONE.finditer(text[MIN_HEX - 1 :: MIN_HEX]):
        at = hit.start() * MIN_HEX + MIN_HEX - 1
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
        done = _HEX_RUN.match(text, start).end()
        if done - start >= MIN_HEX:
            found.append((start, done))
    return found


def scanner() -> Callable[[str | None], list[tuple[int, int, str]]]:
    """A function from a text to its spans (start, end, kind) in order of start, then kind."""
    automaton = _automaton()

    def scan(text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        low = text.replace("İ", "_").lower()  # that letter alone grows in lower case
        spans, ends = [], dict.fromkeys(KEYWORDS, 0)
        hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(low))
        for start, kind in hits:
            if start >= ends[kind] and (m := ANCHORED[kind].match(text, start)):
                ends[kind] = m.end()
                if _valid(kind, m):
                    spans.append((start, m.end(), kind))
        spans += [(a, b, "hex") for a, b in _hex_runs(text)]
        return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))

    return scan


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Append `secrets`, array<struct<start,end,kind>>, to every row of df.

    Null and empty texts have no secrets; repeated rows are scanned each for itself; an empty table gives an empty table;
    other columns pass through, and an input column named secrets is replaced.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])

    def make():
        scan = scanner()
        return lambda texts: [[[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in texts]]

    return map_texts(df, text, [T.StructField("secrets", T.ArrayType(span))], make)


def mask_secrets(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by mark (spans that touch or overlap by one mark). Null stays null. An
    input column named __masked is replaced by the result."""

    def make():
        scan = scanner()

        def one(t):
            if not (spans := scan(t)):
                return t
            out, at = [], 0
            for a, b, _ in spans:
                if a > at or at == 0:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return lambda texts: [[one(t) for t in texts]]

    masked = map_texts(df, text, [T.StructField("__masked", T.StringType())], make)
    return masked.select(*[F.col("__masked").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of scan_secrets over all documents; columns as the contract names them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan_secrets(docs).drop("text")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"),
    )
