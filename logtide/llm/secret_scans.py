"""Secret scans: base patterns, and novelty of other candidates.

A candidate is a run of secret-like characters shortly after a sensitive
word, or after the identifier that holds it; every such run is measured, first its
parts between equals signs, then the whole unless a part is novel. Its novelty is measured with zstandard: the compressor is primed with a
raw dictionary made of common identifiers, the document's own identifiers
near by and the surrounding text without the candidate's own copies, and the candidate's marginal compressed bytes (less those
of an empty frame) are compared with what a random string of its length and
alphabet costs. Words, paths and identifiers
that the dictionary explains shrink; a random key doesn't. A candidate that
stays above NOVELTY is reported as ``novel`` if it mixes letters with digits,
or else if it costs IN_TEXT when compressed as the end of a text: there even
short literals are entropy-coded by the letters of prose, so that words that no
dictionary holds (names, compounds) stay cheap and random letters don't.

Defined results
    * null text: as an empty one, without spans.
    * spans are (kind, start, end) in code points, end exclusive; per kind
      leftmost and non-overlapping; a base match that fails its length test is
      dropped and not searched again inside.
    * ``novel`` spans that overlap a base span are not added.
    * repeated rows are scanned alike; empty tables give no rows; columns that
      are not asked for do not matter.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh_name

#: Order in which kinds are listed where spans begin together.
KINDS = ("assign", "access", "hex", "novel")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: Runs of [0-9a-f] are maximal, so the length test can be part of the pattern.
HEX = re.compile("[0-9a-f]{32,}")

# Words that make a context sensitive, and identifiers that are
# common in code and configuration.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key",
             "accesskey", "private_key", "privatekey", "client_id", "credential", "authorization", "bearer", "auth",
             "signature", "connectionstring", "session_id", "cookie", "license_key")
IDENTIFIERS = (
    "password passwd passphrase pwd secret token api_key apikey access_key private_key client_id client_secret "
    "credential authorization bearer basic auth signature session cookie username user admin root localhost example "
    "default config settings environment production staging development test null none true false string number "
    "value key name type path file url host port https http www com org net io aws_access_key_id "
    "aws_secret_access_key database connection server service account public private import export function return "
    "class const let var self this print required optional your_token_here changeme placeholder xxxxxxxx 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ id_rsa ssh-rsa BEGIN END PRIVATE KEY")

#: Common words and path parts, for the letter frequencies of prose.
WORDS = (
    "the and for with from that this have are was were not you your all can has been will more when which their there "
    "one about would other into time only some could them these than then its over also after first new because any "
    "our work how many most well even way should between through where long before must such make each those people "
    "state right still world life being here both under never same another while last might great year since against "
    "place during without again around however home small found thought went every came made number known used system "
    "program question government development international information organization administration communication "
    "application management computer university department education national community research technology business "
    "service process project product production security network website article content category search contact "
    "privacy policy terms conditions address email phone request response message error failed invalid missing expected "
    "update create delete remove select insert change check verify validate authenticate authorize register login "
    "logout reset expire refresh role group profile customer order payment invoice price shipping city country street "
    "north south east west germany france spain english deutsch gesellschaft verwaltung entwicklung universite "
    "gobierno nacion www.example.com/2019/03/12/how-to-use-it.html https://en.wikipedia.org/wiki/List_of_names "
    "/2018/11/07/ /2020/05/26/ 2017-08-30 /wp-content/uploads/2016/09/image-1.jpg /index.php /tags/ /blog/ /news/")

#: A candidate begins at most this many characters after the identifier with the sensitive word.
REACH = 24
SHORTEST = 16
#: Characters of text on either side that prime the compressor.
SURROUNDINGS = 512
#: Least share of the bytes that a random string of the same length and alphabet
#: takes (its literals are entropy-coded too once it is long); random strings stay
#: near 1, as zstandard finds no match in the dictionary; identifiers fall below.
NOVELTY = 0.85
#: Sets of characters that make an alphabet; symbols count as they occur.
HEX_DIGITS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF")
CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
#: Least bytes per character at the end of a text (less where a random string
#: of the length and alphabet takes less); only measured under CHANGES.
IN_TEXT = 0.72
#: Ends of the text, over which the bytes are averaged, as single ones are rounded.
ENDS = (" ", "\n", ": ", '"')
#: Number of places where a letter meets a digit that mark a mix of both.
LETTER_DIGIT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
CHANGES = 2

CONTEXT = re.compile("(?:" + "|".join(_either(w) for w in sorted(SENSITIVE, key=len, reverse=True)) + ")")
#: The rest of the identifier that holds the sensitive word.
IDENTIFIER_END = re.compile("[A-Za-z0-9_-]*")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=~-]{{{SHORTEST},}}")
#: What joins a key to a name or a path inside one run.
PARTS = re.compile("[=/.~+-]+")


#: Each ASSIGN match holds one of the first, each CONTEXT match one of all of
#: these, in lower case; looking for them first spares most texts the patterns.
ASSIGN_STEMS = ("passw", "secret", "token", "api")
CONTEXT_STEMS = (*ASSIGN_STEMS, "passphrase", "pwd", "key", "credential", "auth", "bearer", "signature",
                 "connectionstring", "session_id", "cookie", "client_id")


def _holds(low: str, stems: tuple[str, ...]) -> bool:
    return any(stem in low for stem in stems)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if _holds(text.lower(), ASSIGN_STEMS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def alphabet_of(candidate: str) -> str:
    """The smallest set of digits or hex digits that holds the candidate, else the classes it uses."""
    used = set(candidate)
    for digits in HEX_DIGITS:
        if used <= set(digits):
            return digits
    known = "".join(c for c in CLASSES if not used.isdisjoint(c))
    return known + "".join(sorted(used - set(known)))


@lru_cache(maxsize=4096)
def random_bytes(alphabet: str, length: int) -> int:
    """Compressed bytes, less an empty frame's, of a random string."""
    import zstandard
    body = "".join(random.Random(length).choices(alphabet, k=length)).encode()
    compressor = zstandard.ZstdCompressor(level=19, write_content_size=False)
    return len(compressor.compress(body)) - len(compressor.compress(b""))


class Novelty:
    """Marginal compressed bytes of a string, given what surrounds it."""

    def __init__(self):
        import zstandard
        self.zstd = zstandard
        self.plain = zstandard.ZstdCompressor(level=19)
        self.empty = len(self.plain.compress(b""))
        texts = [f"{WORDS} {IDENTIFIERS}{end}".encode() for end in ENDS]
        self.texts = [(x, len(self.plain.compress(x))) for x in texts]

    def per_character(self, candidate: str, around: str) -> float:
        known = f"{IDENTIFIERS} {around}".encode("utf-8", "replace")
        primed = self.zstd.ZstdCompressionDict(known, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        compressor = self.zstd.ZstdCompressor(level=19, dict_data=primed, write_content_size=False,
                                              write_dict_id=False)
        body = candidate.encode()
        return max(0, len(compressor.compress(body)) - self.empty) / len(body)

    def share(self, candidate: str, around: str) -> float:
        """Marginal bytes as a share of those of a random string."""
        return self.per_character(candidate, around) * len(candidate) / random_bytes(alphabet_of(candidate), len(candidate))


    def in_text(self, candidate: str) -> float:
        """Bytes per character that the candidate adds at the end of a text, the mean over its ENDS."""
        body = candidate.encode()
        added = [len(self.plain.compress(text + body)) - size for text, size in self.texts]
        return sum(added) / len(added) / len(body)

    def is_novel(self, candidate: str, around: str) -> bool:
        if self.share(candidate, around) < NOVELTY:
            return False
        if len(LETTER_DIGIT.findall(candidate)) >= CHANGES:
            return True
        least = random_bytes(alphabet_of(candidate), len(candidate)) / len(candidate)
        return self.in_text(candidate) >= min(IN_TEXT, NOVELTY * least)


def surroundings(text: str, start: int, stop: int) -> str:
    """SURROUNDINGS characters on either side, other copies of the candidate
    and of its long parts blanked: a key that stands twice explains nothing."""
    body, margin = text[start:stop], stop - start
    before, after = text[max(0, start - SURROUNDINGS - margin):start], text[stop:stop + SURROUNDINGS + margin]
    for part in sorted({body, *(x for x in PARTS.split(body) if len(x) >= SHORTEST)}, key=len, reverse=True):
        blank = " " * len(part)
        before, after = before.replace(part, blank), after.replace(part, blank)
    return before[-SURROUNDINGS:] + " " + after[:SURROUNDINGS]


def novel_spans(text: str, taken: list[tuple[str, int, int]], measure: Novelty) -> list[tuple[str, int, int]]:
    spans, end, named = [], 0, 0
    if not _holds(text.lower(), CONTEXT_STEMS):
        return spans
    for context in CONTEXT.finditer(text):
        if context.end() > named:
            named = IDENTIFIER_END.match(text, context.end()).end()
        begin = max(context.end(), end)
        while m := CANDIDATE.search(text, begin, named + REACH + SHORTEST):
            m = CANDIDATE.match(text, m.start())  # to the end of its run
            begin = end = m.end()
            found = []
            for start, stop in parts_of(text, m.start(), m.end()):
                if any(a < stop and start < b for _, a, b in [*taken, *found]):
                    continue
                if measure.is_novel(text[start:stop], surroundings(text, start, stop)):
                    found.append(("novel", start, stop))
            spans += found
    return spans


def parts_of(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """The parts of a run between equals signs, then the run as a whole; all
    without outer signs and at least SHORTEST long."""
    pieces = [(start + m.start(), start + m.end()) for m in re.finditer("[^=]+", text[start:stop])]
    bare = []
    for a, b in [*pieces, (start, stop)]:
        body = text[a:b]
        bare.append((a + len(body) - len(body.lstrip("=.-")), b - len(body) + len(body.rstrip("=.-"))))
    return [x for x in dict.fromkeys(bare) if x[1] - x[0] >= SHORTEST]


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(text: str | None, measure: Novelty) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, novel spans)."""
    base = base_spans(text or "")
    return base, novel_spans(text or "", base, measure)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for batch in batches:
            counts, digests, spans = {k: [] for k in KINDS[:3]}, [], []
            for value in batch.column(1):  # one text at a time as a Python string
                base, novel = scan(value.as_py(), measure)
                for k, into in counts.items():
                    into.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + novel))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts.values()],
                 pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(search, f"`{key}` {key_type}, n_assign long, n_access long, n_hex long, "
                                   "base_sha256 string, spans string")


def redacted(text: Column, mark: str = "[SECRET]") -> Column:
    """The text with every base and novel span replaced by ``mark`` (null stays null)."""
    @pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        measure, out = Novelty(), []
        for value in texts:
            if value is None:
                out.append(None)
                continue
            base, novel = scan(value, measure)
            parts, end = [], 0
            for _, a, b in sorted(base + novel, key=lambda s: s[1:]):
                if a >= end:
                    parts += [value[end:a], mark]
                end = max(end, b)
            out.append("".join(parts) + value[end:])
        return pd.Series(out, dtype="object")
    return replace(text)


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets masked; ``chars``, if there is such a column,
    follows the new length where the text changed."""
    new = fresh_name(docs, "masked_text")
    rows = docs.withColumn(new, redacted(F.col(text)))
    if chars in docs.columns:
        length = F.when(F.col(new).eqNullSafe(F.col(text)), F.col(chars)).otherwise(F.length(new))
        rows = rows.withColumn(chars, length.cast(docs.schema[chars].dataType))
    return rows.withColumn(text, F.col(new)).drop(new)
