"""Media columns: what stored bytes really are, by magic bytes and checks of structure and lengths.

An Aho-Corasick automaton finds all magic bytes of a value in one pass; a validator of the format then confirms header
fields and lengths. A value whose start is confirmed as another format than declared has its type corrected; confirmed
files inside it are carved with their exact spans."""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks
from .scratch import quoted, whole_row, without


class File:
    """A value with the places of its end marks, each kind found in one pass, when a validator first asks."""

    def __init__(self, data: bytes):
        self.data = data

    @functools.cached_property
    def zeros(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0)

    @functools.cached_property
    def pdf_starts(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-\d", self.data)]

    @functools.cached_property
    def pdf_ends(self) -> list[tuple[int, int, int]]:
        """End, place of startxref, and the offset that it tells."""
        return [(m.end(), m.start(), int(m[1])) for m in re.finditer(rb"startxref\s{1,8}(\d{1,12})\s{1,8}%%EOF", self.data)]

    @functools.cached_property
    def zip_ends(self) -> dict[int, int]:
        """The end of each ZIP archive by the start that its end record tells."""
        found: dict[int, int] = {}
        b = self.data
        for m in re.finditer(rb"PK\x05\x06", b):
            at = m.start()
            if at + 22 > len(b):
                break
            size, start, note = struct.unpack_from("<IIH", b, at + 12)
            first = at - size - start
            if first >= 0 and at + 22 + note <= len(b) and (size == 0 or b[first + start : first + start + 4] == b"PK\x01\x02"):
                found[first] = at + 22 + note
        return found


def _png(f: File, at: int) -> int | None:
    """End of a PNG file: chunks with right CRCs from IHDR to IEND."""
    b, p, first = f.data, at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return None


def _jpeg(f: File, at: int) -> int | None:
    """End of a JPEG file: marker segments with lengths, then scan data up to EOI. Bytes FF may fill up before a marker."""
    b, p, scanned = f.data, at + 2, False
    while p + 2 <= len(b) and b[p] == 0xFF:
        while p + 2 <= len(b) and b[p + 1] == 0xFF:
            p += 1
        if p + 2 > len(b):
            return None
        marker = b[p + 1]
        if marker == 0xD9:
            return p + 2 if scanned else None
        if marker < 0xC0 or 0xD0 <= marker <= 0xD8 or p + 4 > len(b):
            return None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if marker == 0xDA:
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return None


def _gif(f: File, at: int) -> int | None:
    """End of a GIF file: screen descriptor, colour tables and blocks up to the trailer."""
    b = f.data
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(q: int) -> int:
        while q < len(b) and b[q]:
            q += b[q] + 1
        return q + 1

    seen = False
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 if seen else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
            seen = True
        else:
            return None
    return None


def _riff(kinds: tuple[bytes, ...]) -> Callable[[File, int], int | None]:
    def check(f: File, at: int) -> int | None:
        """End of a RIFF file of these kinds: its chunks fill the declared size."""
        b = f.data
        if at + 12 > len(b) or b[at + 8 : at + 12] not in kinds:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        p, n = at + 12, 0
        while p + 8 <= end:
            p += 8 + struct.unpack_from("<I", b, p + 4)[0]
            p += p - at & 1
            n += 1
        return end if n and p in (end, end + 1) else None

    return check


def _bmp(f: File, at: int) -> int | None:
    """End of a BMP file: sizes of file, header and rows agree."""
    b = f.data
    if at + 54 > len(b):
        return None
    size, _, pixels, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if head < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or at + size > len(b):
        return None
    return at + size if pixels >= 14 + head and size >= pixels + (width * bits + 31) // 32 * 4 * abs(height) > pixels else None


def _pdf(f: File, at: int) -> int | None:
    """End of a PDF file: a version, and the last end mark before the next PDF file whose startxref tells a place before
    it (files saved again have several). A file without one before the next encloses that one."""
    if not f.data[at + 5 : at + 6].isdigit():
        return None
    after = bisect.bisect_right(f.pdf_starts, at)
    limit = f.pdf_starts[after] if after < len(f.pdf_starts) else len(f.data)
    first = bisect.bisect_left(f.pdf_ends, (at, 0, 0))
    last = bisect.bisect_right(f.pdf_ends, (limit, len(f.data), 0))
    end, mark, told = f.pdf_ends[last - 1] if last > first else (f.pdf_ends or [(0, 0, 0)])[-1]
    return end if end > at and at + told < mark else None


def _gzip(f: File, at: int) -> int | None:
    """End of a gzip member: a header whose parts end, and data that can be unpacked, CRC and length included."""
    b = f.data
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    p = at + 10
    if b[at + 3] & 4:
        p += 2 + struct.unpack_from("<H", b, p)[0]
    for flag in (8, 16):  # a name and a note, each up to a byte 0
        if b[at + 3] & flag:
            k = int(np.searchsorted(f.zeros, p))
            if k == len(f.zeros):
                return None
            p = int(f.zeros[k]) + 1
    if p + 8 > len(b):
        return None
    unpack, p, step = zlib.decompressobj(31), at, 512
    try:
        while p < len(b) and not unpack.eof:
            unpack.decompress(b[p : p + step])
            p, step = p + step, 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(unpack.unused_data) if unpack.eof else None


def _zip(f: File, at: int) -> int | None:
    """End of a ZIP archive: the end record whose directory, right before it, makes the archive start here."""
    return f.zip_ends.get(at)


def _flac(f: File, at: int) -> int | None:
    """End of a FLAC file: metadata blocks from STREAMINFO on, then a frame. Frames tell no length, so it ends the value."""
    b, p, first = f.data, at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if (first and (kind & 0x7F or n != 34)) or kind & 0x7F == 0x7F:
            return None
        p, first = p + 4 + n, False
        if kind & 0x80:
            return len(b) if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(f: File, at: int) -> int | None:
    """End of an Ogg file: pages of one stream, numbered without a gap, from the first to the last one."""
    b, p, number, stream = f.data, at, 0, None
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        flags, _, own, seq, _, n = struct.unpack_from("<BqIIIB", b, p + 5)
        if seq != number or (stream is not None and own != stream) or bool(flags & 2) != (number == 0) or p + 27 + n > len(b):
            return None
        stream, number, p = own, number + 1, p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if flags & 4:
            return p
    return None


#: Types of boxes at the top of an MP4 file.
BOXES = {b"ftyp", b"styp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"meta", b"sidx", b"uuid", b"pdin"}


def _mp4(f: File, at: int) -> int | None:
    """End of an MP4 file: boxes with lengths from ftyp on, among them one that describes and one that holds data."""
    b, p, seen = f.data, at, set()
    while p + 8 <= len(b) and (b[p + 4 : p + 8] in BOXES):
        n, head = struct.unpack_from(">I", b, p)[0], 8
        if n == 1 and p + 16 <= len(b):
            n, head = struct.unpack_from(">Q", b, p + 8)[0], 16
        if n < head or p + n > len(b):
            return None
        seen.add(b[p + 4 : p + 8])
        p += n
    return p if b"moov" in seen and seen & {b"mdat", b"moof"} else None


def _tiff(f: File, at: int) -> int | None:
    """End of a TIFF file: directories whose entries, values and strips lie in the value; the last of these ends it."""
    b, order = f.data, "<" if f.data[at : at + 2] == b"II" else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    if at + 8 > len(b):
        return None
    p, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], 8, set()
    while p and p not in seen:
        seen.add(p)
        n = struct.unpack_from(order + "H", b, at + p)[0] if p >= 8 and at + p + 2 <= len(b) else 0
        if not n or at + p + 6 + 12 * n > len(b):
            return None
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind, many, value = struct.unpack_from(order + "HHII", b, at + p + 2 + 12 * k)
            if kind not in sizes or at + many * sizes[kind] > len(b):
                return None
            place = value if many * sizes[kind] > 4 else p + 10 + 12 * k
            if at + place + many * sizes[kind] > len(b):
                return None
            end = max(end, place + many * sizes[kind])
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                tags[tag] = struct.unpack_from(f"{order}{many}{'H' if kind == 3 else 'I'}", b, at + place)
        for starts, lengths in ((273, 279), (324, 325)):
            for a, m in zip(tags.get(starts, ()), tags.get(lengths, ()), strict=False):
                end = max(end, a + m)
        end, p = max(end, p + 6 + 12 * n), struct.unpack_from(order + "I", b, at + p + 2 + 12 * n)[0]
    return at + end if seen and at + end <= len(b) else None


#: Magic bytes, their place in a file, media type and validator of each known format.
FORMATS: list[tuple[bytes, int, str, Callable[[File, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"II*\0", 0, "image/tiff", _tiff),
    (b"MM\0*", 0, "image/tiff", _tiff),
    (b"RIFF", 0, "audio/wav", _riff((b"WAVE",))),
    (b"RIFF", 0, "image/webp", _riff((b"WEBP",))),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"BM", 0, "image/bmp", _bmp),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\x03\x04", 0, "application/zip", _zip),
]


@functools.cache
def automaton():
    """The magic bytes of all formats, as characters of Latin-1, each with its formats."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in dict.fromkeys(m for m, *_ in FORMATS):
        found.add_word(magic.decode("latin-1"), (len(magic), [f[1:] for f in FORMATS if f[0] == magic]))
    found.make_automaton()
    return found


def sniff(data: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The confirmed type of the whole value, or None, and confirmed files (type, start, end) inside it.

    Files are taken from left to right; what a carved file holds is part of it. The whole value isn't in the list."""
    whole, parts, free, file = None, [], 0, File(data)
    for last, (size, formats) in automaton().iter(data.decode("latin-1")):
        for back, kind, check in formats:
            at = last - size + 1 - back
            if at >= free and (end := check(file, at)) is not None:
                if at == 0:
                    whole = kind
                else:
                    parts.append((kind, at, end))
                free = end  # a file that fills the value holds all else in it
                break
    return whole, parts


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """A WAV file of 8-bit mono samples."""
    odd = len(samples) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * odd


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """The samples of a confirmed 8-bit mono WAV file and their rate, found by its chunks."""
    p, rate = 12, 0
    while p + 8 <= len(data):
        kind, n = data[p : p + 4], struct.unpack_from("<I", data, p + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, p + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return data[p + 8 : p + 8 + n], rate
        p += 8 + n + (n & 1)
    raise ValueError("no samples")


def text_payload(text: str | None, block: int = 64) -> tuple[int, bytes]:
    """The length of the UTF-8 text and its bytes, with bytes 0 up to a positive multiple of `block`."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (max(block, -(-len(raw) // block) * block) - len(raw))


def sound_features(samples: bytes, rate: int) -> str:
    """Level, spread, sign changes and entropy of 8-bit samples around their middle of 128."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256)
    p = share[share > 0] / max(len(x), 1)
    level = x.astype(np.float32) - 128
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    return f"rate={rate};n={len(x)};mean={level.mean(dtype=float) if len(x) else 0:.4f};rms={float(np.sqrt(np.mean(level * level, dtype=float))) if len(x) else 0:.4f};crossings={crossings};entropy={abs(float(-(p * np.log2(p)).sum())):.4f}"


MEDIA = T.StructType([T.StructField("declared_type", T.StringType()), T.StructField("media", T.BinaryType())])
#: Types that stored texts are declared as; all but the last are wrong.
DECLARED = ["application/octet-stream", "image/png", "application/zip", "audio/wav"]
PARTS = "array<struct<type:string,start:long,end:long>>"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, declared_type, media): each text stored losslessly as a sound of 8-bit samples.

    The declared type is what a careless producer would write, by turns of the payload's checksum one of DECLARED, for
    sniff_media() to correct. Null texts are stored like empty ones: 64 samples of 0. Ids may be null or repeat; an empty
    table gives no rows; other columns are ignored. Long texts are stored whole."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lengths, files, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                n, payload = text_payload(text)
                lengths.append(n)
                files.append(wav(payload))
                kinds.append(DECLARED[zlib.crc32(payload) % len(DECLARED)])
            declared = pa.array(kinds, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), declared, pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "declared_type", "media"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(store, "doc_id long, n_bytes long, declared_type string, media binary")


def sniff_media(stored: DataFrame, media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """stored plus media_type (confirmed, else the declared one), corrected, and parts (type, start, end) carved from it.

    Null media keep the declared type and have no parts; empty media too. Columns of these three names are replaced."""
    base = stored.select(whole_row(stored.select(*map(quoted, without(stored, "media_type", "corrected", "parts")))))
    schema = T.StructType([*base.schema.fields, T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("parts", T._parse_datatype_string(PARTS))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, names = batch.column("row"), [f.name for f in batch.schema.field("row").type]
            media, declared = (row.field(names.index(c)) for c in (media_col, declared_col))
            kinds, parts = [], []
            for data, told in zip(media, declared, strict=True):  # one value at a time
                raw = data.as_py()
                whole, inside = sniff(raw) if raw else (None, [])
                kinds.append((whole or told.as_py(), whole is not None and whole != told.as_py()))
                parts.append([{"type": k, "start": a, "end": b} for k, a, b in inside])
            shape = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            more = [pa.array([k for k, _ in kinds], pa.string()), pa.array([c for _, c in kinds], pa.bool_()), pa.array(parts, shape)]
            yield pa.RecordBatch.from_arrays([row, *more], names=["row", "media_type", "corrected", "parts"])

    return base.mapInArrow(find, schema).select("row.*", "media_type", "corrected", "parts")


def carve(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each embedded file: the columns of sniffed but its parts, and part_type, part_start, part (bytes),
    which replace columns of these names. A row without embedded files gives none."""
    names = without(sniffed, "parts", "part_type", "part_start", "part")
    rows = sniffed.select(whole_row(sniffed.select(*map(quoted, names))), F.explode("parts").alias("part"))
    piece = F.substring(F.col(f"row.{quoted(media_col)}"), (F.col("part.start") + 1).cast("int"), (F.col("part.end") - F.col("part.start")).cast("int"))
    return rows.select("row.*", F.col("part.type").alias("part_type"), F.col("part.start").alias("part_start"), piece.alias("part"))


def sound_digests(sniffed: DataFrame) -> DataFrame:
    """From stored sounds, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, media_type, n_parts. Rows whose media isn't a confirmed sound have null payload columns."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_parts int"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            rows = []
            for doc_id, n, media, kind, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "media_type", "n_parts")), strict=True):
                seen = (None, None, None, None)
                if kind == "audio/wav":
                    samples, rate = wav_samples(media)
                    seen = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), sound_features(samples, rate))
                rows.append((doc_id, n, *seen[:3], len(media or b""), hashlib.sha256(media or b"").hexdigest(), seen[3], kind, parts))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return sniffed.select("doc_id", "n_bytes", "media", "media_type", F.size("parts").alias("n_parts")).mapInArrow(digest, schema)
