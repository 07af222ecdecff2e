"""Secret scan: fixed patterns, and strings that a tokenizer's vocabulary compresses badly.

Base kinds, in this order: ``assign`` (a value given to a name such as password or token), ``access`` (AKIA keys) and
``hex`` (long runs of hex digits). Matches are leftmost and don't overlap within a kind; those too short are dropped.

The kind ``random`` comes from token efficiency: characters per token of a string under a tiktoken vocabulary. Words,
names and paths take few tokens, random strings many. Known digests (hex of the length of MD5, SHA-1, SHA-2) and
identifiers (UUIDs, numbers, dates, dotted or underscored words, addresses) are left out first. Words are letters in one
case pattern: lower, UPPER, Capitalised or camelCase of parts with a vowel; other mixed-case strings are left to the
test, with digits or without. What a base span covers is cut out of a string, and the rests that are long enough are tested.

Defined results: a null text counts as empty and has no spans; spans count code points, the end is exclusive; repeated rows
give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, map_texts

KINDS = ("assign", "access", "hex", "random")
# The base patterns. Letters are ASCII in either case for assign.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole or not at all, as with + and the length checked after
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

#: Strings that the efficiency test looks at, and the characters per token under which one counts as random.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CHARS_PER_TOKEN = 2.1
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORD = r"(?:[a-z]++|[A-Z]++|[A-Z][a-z]++|[A-Z]?(?=[a-z]*[aeiouy])[a-z]{2,}+(?:[A-Z](?=[a-z]*[aeiouy])[a-z]{2,}+)*+)"
_PART = rf"(?:{_WORD}[0-9]{{0,4}}|[0-9]+)"
_IDENTIFIER = re.compile(rf"{_PART}(?:[_/.-]+{_PART})*[_/.-]*")
_WORDS_ONLY = re.compile(rf"[_/=+-]*{_WORD}(?:[_/=+-]+{_WORD})*[_/=+-]*")
_LETTER = re.compile(r"[A-Za-z]")
SHORTEST = 16  # as in CANDIDATE

SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def excluded(string: str) -> bool:
    """Known digests and identifiers, and what has no letters."""
    if not _LETTER.search(string):
        return True
    if len(string) in DIGEST_LENGTHS and _DIGEST.fullmatch(string):
        return True
    return bool(_UUID.fullmatch(string) or _IDENTIFIER.fullmatch(string) or _WORDS_ONLY.fullmatch(string))


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind. ``runs``: the text's CANDIDATE matches, in which every hex run lies."""
    found, lower = [], text.lower()
    if any(name in lower for name in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    for run in CANDIDATE.finditer(text) if runs is None else runs:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return found


def rests(runs: list[re.Match], covered: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the base spans leave of ``runs``, in pieces that are long enough."""
    cuts: list[list[int]] = []  # apart from each other, in order
    for start, end in sorted((s, e) for _, s, e in covered):
        if cuts and start <= cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], end)
        else:
            cuts.append([start, end])
    found, k = [], 0
    for m in runs:
        at, end = m.span()
        while k < len(cuts) and cuts[k][0] < end:
            if cuts[k][0] - at >= SHORTEST:
                found.append((at, cuts[k][0]))
            at = max(at, cuts[k][1])
            if at > end:  # it reaches into the next run
                break
            k += 1
        if end - at >= SHORTEST:
            found.append((at, end))
    return found


def random_spans(
    text: str, runs: list[re.Match], n_tokens: Callable[[str], int], covered: list[tuple[str, int, int]], threshold: float = CHARS_PER_TOKEN
) -> list[tuple[str, int, int]]:
    """The strings of ``runs`` outside base spans that take many tokens for their length."""
    found = []
    for start, end in rests(runs, covered):
        string = text[start:end]
        if not excluded(string) and len(string) < threshold * n_tokens(string):
            found.append(("random", start, end))
    return found


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None, threshold: float = CHARS_PER_TOKEN) -> DataFrame:
    """``keep`` columns and ``spans``: kind, start and end of every secret in each text.

    The vocabulary has a fixed size and is broadcast.
    """
    with open(vocabulary or default_vocabulary(), "rb") as file:
        told = df.sparkSession.sparkContext.broadcast(file.read())

    def start():
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, told.value.splitlines())}
        coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        n_tokens = Cache(lambda s: len(coder.encode_ordinary(s))).__getitem__

        def handle(t):
            if not t:
                return ([],)
            runs = list(CANDIDATE.finditer(t))
            base = base_spans(t, runs)
            return ([dict(zip(("kind", "start", "end"), s)) for s in in_order(base + random_spans(t, runs, n_tokens, base, threshold))],)

        return handle

    return map_texts(df, keep, text, start, SPANS)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, counts by base kind, digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select(
        *keep,
        *(count(kind) for kind in KINDS),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("marked"))

    def step(done, span):
        before = F.substring(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        fresh = span["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(done["out"], before, F.lit(mark))).otherwise(done["out"]).alias("out"),
            (done["marked"] + 1).alias("marked"),
        )

    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))
