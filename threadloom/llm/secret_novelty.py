"""Secret scan by dictionary-primed zstandard novelty, beside three fixed patterns.

Patterns (assign, access, hex) give the base spans. Then every other long run of key-like characters that stands within
``REACH`` characters after a sensitive word is a candidate: its own size is its compressed length after a dictionary of
common code and identifier words and of the ``AROUND`` characters on both sides of it (less copies of itself, so that a
key that stands there twice is found twice). A candidate is reported as ``novel`` if its own size reaches
``LEAST`` of what random characters of its alphabet need (base64 codes at six bits a character, hex at four), and its letter
pairs are as improbable among those words as random ones are. ``marginal_bytes`` of a span is the compressed length of the
text before it plus the span, less that of the text before it alone; it jumps where a short head starts to be entropy-coded,
which is why it is not what decides.

Texts are scanned whole, in one pass without a shuffle; each row depends on itself alone, so neither hot keys nor
repeated rows matter.

Defined results: a null or empty text has no spans; a very long text is scanned whole, only the compressor's view of a
candidate's surroundings is bounded; equal texts have equal spans; an empty table gives an empty result;
``scan`` keeps all columns but one named ``spans``; ``redacted`` returns the columns it was given.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import light_batches, slices, table

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns of the contract; the lengths are those that matches need to count.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words that make a context sensitive, and runs that may be keys: 20 characters or more, a digit or mixed case among them.
CONTEXT = re.compile(r"(?i:passw|secret|token|api.?key|credential|private|auth|bearer|signature|access.?key|client.?id)", re.ASCII)
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9]|[A-Z+/_=-]*[a-z][a-z+/_=-]*[A-Z]|[a-z+/_=-]*[A-Z][A-Z+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}")
REACH, AROUND, LEAST = 48, 512, 0.95
#: Bits a letter pair must have on average; of random keys of 20 mixed-case letters, the least sure kind, one in a few hundred has less.
SURPRISE = 4.4
#: Sizes of the alphabets that a key may come from.
ALPHABETS = (("0-9", 10), ("0-9a-f", 16), ("0-9A-F", 16), ("a-z", 26), ("A-Z", 26), ("0-9a-z", 36), ("0-9A-Z", 36), ("A-Za-z", 52), ("0-9A-Za-z", 62), ("0-9A-Za-z+/=_-", 64))
OF_ALPHABET = [(re.compile(f"[{chars}]+"), math.log2(n)) for chars, n in ALPHABETS]
CASE, DIGIT, OTHER = re.compile("(?<=[a-z])(?=[A-Z])"), re.compile("[0-9]"), re.compile("[^a-z0]+")
#: Common code and identifier words that the compressor knows beforehand.
WORDS = """
 access account action address admin agent alias allow amount answer api app append apply argument array assert async attribute auth await backend base batch bearer begin binary block body
 boolean branch break bucket buffer build button byte cache call case catch change channel char check child class clean clear click client clone close cluster code color column command
 comment commit compare compile component config connect console const constructor container content context continue control cookie copy count create credential current cursor data
 database date debug declare default define delete deploy description dict digest directory disable display document domain double download driver edit element else email empty enable
 encode end endpoint enum environment error event except exception execute exit expect export expression extend false fetch field file filter final finally find flag float folder font for
 format frame from function generate get global group handle handler hash header height hidden host html http https icon id if image implements import include index info init inner input
 insert install instance int integer interface internal item iterator job join json key label lambda language last layout left length level library license limit line link list listen load
 local lock log login long loop main make manager map mask master match max member memory merge message metadata method migrate min mode model module mount move name namespace new next node
 none notify null number object offset open operator option order origin output override package page param parent parse partition password patch path pattern payload pending permission
 pipeline plugin point policy pool port position post prefix print private process product profile project promise property protected protocol provider proxy public pull push query queue
 random range read record redirect reference region register release reload remote remove render replace report repository request require reset resource response result return role root
 route row rule run save scale schema scope screen script search secret section select self send sequence server service session set setting shape share shell show signature size socket sort
 source spec split stack start state static status step stop storage store stream string struct style submit subscribe success super switch symbol sync system table tag target task template
 test text theme this thread throw time timeout timestamp title token tool total trace transaction transform trigger true try tuple type undefined union unique unit unknown update upload url
 user username util valid validate value var vector verify version view visible void wait while width window with worker wrapper write xml yield zone
 application attempt authorization bytes certificate characters clients credentials customer days default_value development directory_name domain_name email_address encryption environment_name factory
 function_name hours identifier instance_id interval keys maximum metrics milliseconds minimum minutes monitoring names notification numbers organization parameter parameters period production provider_id
 refresh region_name requests responses results retries retry seconds secrets settings staging subscription success temporary timestamps tokens total_count users values version_number webhook workspace
"""


class Novelty:
    """Marginal compressed bytes of a string after its context."""

    def __init__(self):
        import zstandard

        raw = " ".join(WORDS.split())
        pairs = Counter(zip(f"_{_symbols(raw)}", _symbols(raw), strict=False))
        first = Counter(a for a, _ in pairs.elements())
        self.cost = {(a, b): math.log2((first[a] + 14) / (pairs[a, b] + 0.5)) for a in SYMBOLS for b in SYMBOLS}
        self.raw = raw = f"{raw} {raw.title()} {raw.upper()}".encode()
        self.pack = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, before: str, found: str) -> int:
        head = before.encode("utf-8", "surrogatepass")
        return len(self.pack.compress(head + found.encode("utf-8", "surrogatepass"))) - len(self.pack.compress(head))

    def own(self, before: str, found: str, after: str = "") -> int:
        """Compressed bytes of a string, where what stands around it is part of the dictionary."""
        import zstandard

        known = zstandard.ZstdCompressionDict(self.raw + f" {after} {before}".replace(found, "").encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pack = zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(pack.compress(found.encode())) - len(self.pack.compress(b""))

    def surprise(self, found: str) -> float:
        """Bits of a letter after the one before it, on average, from the pairs of the dictionary's words."""
        s = _symbols(found)
        return sum(map(self.cost.__getitem__, zip(f"_{s}", s, strict=False))) / len(s)

    def is_key(self, before: str, found: str, after: str = "") -> bool:
        if self.surprise(found) < SURPRISE:
            return False
        return 8 * self.own(before, found, after) >= LEAST * len(found) * next(bits for chars, bits in OF_ALPHABET if chars.fullmatch(found))


SYMBOLS = "abcdefghijklmnopqrstuvwxyz0_"


def _symbols(text: str) -> str:
    """Lower case, 0 for every digit, _ between words and where an upper-case letter follows a lower-case one."""
    return OTHER.sub("_", DIGIT.sub("0", CASE.sub("_", text).lower()))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if "=" in text or ":" in text else []
    out += [(*m.span(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _is_open(start: int, end: int, base: list[tuple[int, int, str]]) -> bool:
    """Whether base spans leave a run to be judged: an assignment takes it whole, lower-case hex within it only itself."""
    over = [(max(a, start), min(b, end), kind) for a, b, kind in base if a < end and start < b]
    return all(kind == "hex" for *_, kind in over) and end - start - sum(b - a for a, b, _ in over) >= (8 if over else 1)


def find_spans(text: str | None, novelty: Novelty) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, marginal bytes), by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    out = list(base)
    sensitive = [m.end() for m in CONTEXT.finditer(text)]
    if sensitive:
        k = -1  # the last sensitive word before a run
        for m in RUN.finditer(text):
            while k + 1 < len(sensitive) and sensitive[k + 1] <= m.start():
                k += 1
            if k >= 0 and m.start() - sensitive[k] <= REACH and _is_open(*m.span(), base):
                if novelty.is_key(text[max(0, m.start() - AROUND) : m.start()], m[0], text[m.end() : m.end() + AROUND]):
                    out.append((*m.span(), "novel"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return [(a, b, kind, novelty(text[max(0, a - AROUND) : a], text[a:b])) for a, b, kind in out]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal_bytes", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("marginal_bytes", pa.int64())]))


def scan(docs: DataFrame, drop_text: bool = False) -> DataFrame:
    """The documents with ``spans``, in place of a column of that name."""
    given = docs.drop("spans")
    names = [n for n in given.columns if not (drop_text and n == "text")]
    at, keep = given.columns.index("text"), [given.columns.index(n) for n in names]
    schema = T.StructType([*(given.schema[n] for n in names), T.StructField("spans", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in slices(batches, at):
            found = [find_spans(t, novelty) for t in b.column(at).to_pylist()]
            spans = pa.array([[{"kind": k, "start": x, "end": y, "marginal_bytes": z} for x, y, k, z in s] for s in found], SPAN_ARROW)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), spans], [*names, "spans"])

    return light_batches(given).mapInArrow(run, schema)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All documents and columns as before, with every span replaced by ``mark`` in text, and n_chars (if there) to match."""
    names = list(docs.columns)
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in slices(batches, at):
            texts, columns = b.column(at).to_pylist(), list(b.columns)
            found = [find_spans(t, novelty) for t in texts]
            if any(found):
                clean = [_without(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)]
                if length is not None:
                    before = columns[length].to_pylist()
                    columns[length] = pa.array([len(c) if s else n for c, s, n in zip(clean, found, before, strict=True)], columns[length].type)
                columns[at] = pa.array(clean, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return light_batches(docs).mapInArrow(run, docs.schema)


def _without(text: str, spans: list, mark: str) -> str:
    out, at = [], 0
    for a, b, *_ in spans:
        if b > at:
            out += [text[at : max(at, a)], mark] if a >= at else []
            at = max(at, b)
    return "".join([*out, text[at:]])


def op7_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), count("novel").alias("n_novel"))


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, *_ in spans if k != "novel").encode()).hexdigest()
