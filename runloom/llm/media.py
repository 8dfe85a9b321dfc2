"""Media columns: texts as 8-bit WAV sound and its spectral-peak fingerprint.

The wave module writes and reads the sound. Its short-time Fourier transform
gives, in each frame, the strongest bin of a few bands; a peak is paired with
those of higher bands in its frame and with the next peaks after it in its own band,
and a pair (bin, other bin, distance in time) with the time of its first peak makes
one code of the fingerprint. Frames are well under a block, and half a frame of rest
stands before and after the sound, so that its first and last samples count in full.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BLOCK = 576
RATE = 8000
FRAME, HOP = 128, 64
BANDS = ((2, 6), (6, 15), (15, 33), (33, 65))
REACH = 2
#: Frames that are transformed at once: bounds memory for very long texts.
AT_ONCE = 2048
#: Of a whole period, so that a constant sound is in no band.
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def payload_of(data: bytes, block: int = BLOCK) -> bytes:
    """``data`` filled up with bytes 255 to a positive multiple of ``block``."""
    size = max(1, -(-len(data) // block)) * block
    return data + b"\xff" * (size - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """For each frame and band the bin of the strongest amplitude, -1 if it is silent."""
    rest = b"\xff" * HOP  # what payloads are filled up with
    x = (np.frombuffer(rest + samples + rest, np.uint8).astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS)), np.int64)
    for i in range(0, len(frames), AT_ONCE):
        power = np.abs(np.fft.rfft(frames[i : i + AT_ONCE] * _WINDOW, axis=1))
        for k, (a, b) in enumerate(BANDS):
            band = power[:, a:b]
            top = band.argmax(1)
            out[i : i + AT_ONCE, k] = np.where(band[np.arange(len(top)), top] > 1e-3, top + a, -1)
    return out


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs, int64: time << 24 | bin << 14 | other bin << 4 | distance in frames."""
    p = peaks(samples)
    t = np.arange(len(p), dtype=np.int64)[:, None]
    codes = []
    for i, j in combinations(range(len(BANDS)), 2):
        a, b = p[:, i], p[:, j]
        codes.append(np.where((a >= 0) & (b >= 0), t[:, 0] << 24 | a << 14 | b << 4, -1))
    for d in range(1, REACH + 1):
        if len(p) > d:
            a, b = p[:-d], p[d:]
            codes.append(np.where((a >= 0) & (b >= 0), t[:-d] << 24 | a << 14 | b << 4 | d, -1).ravel())
    found = np.concatenate(codes)
    return np.sort(found[found >= 0])


def media_columns(docs: DataFrame, digests: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, media (the WAV file) and fingerprint.

    With ``digests`` the columns are what the stored bytes add up to instead:
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (sha256 of the fingerprint's little-endian codes), n_codes and the
    fingerprint itself. A null or empty text is one block of bytes 255: a constant sound, which
    has no peaks and so no codes. Rows stay one to one, repeated ones too; an empty table
    stays empty; other columns of ``docs`` are not read. Rows are worked on one by one, so that
    memory is bounded by the longest text.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    full = f"doc_id {kind}, n_bytes long, media binary, fingerprint array<long>"
    brief = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_codes long, fingerprint array<long>"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for i in range(0, b.num_rows, 64):  # the WAV files of few rows at a time
                made = []
                for v in texts[i : i + 64]:
                    data = v.as_py()
                    media = to_wav(payload_of(data))
                    back = from_wav(media)
                    code = fingerprint(back)
                    if digests:
                        made.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(code.astype("<i8").tobytes()).hexdigest(), len(code), code))
                    else:
                        made.append((len(data), media, code))
                cols = list(zip(*made, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())] if digests else [pa.int64(), pa.binary(), pa.list_(pa.int64())]
                names = [f.split()[0] for f in (brief if digests else full).split(", ")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i : i + 64], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return rows.mapInArrow(convert, brief if digests else full)
