import zlib

import numpy as np
import pytest

from packwright.llm.bpe import ByteBpe
from packwright.llm.files import filesystem, new_folder, write_whole
from packwright.llm.token_files import Format, FrameWriter, TokenFile, read_token_files, token_files_round_trip, write_token_files

from .conftest import EDGE_TEXTS


def brute(rows, vocabulary):
    library, start, out = ByteBpe(vocabulary).library, 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(frame, vocabulary):
    rows = EDGE_TEXTS + [(100 + i, f"document number {i} " * (i % 7)) for i in range(200)]
    got = token_files_round_trip(frame(rows), vocabulary, layout=Format(frame_tokens=50)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows, vocabulary)
    assert token_files_round_trip(frame(rows).limit(0), vocabulary).count() == 0


def test_reader_fetches_one_frame(frame, spark, vocabulary):
    docs = frame([(i, f"text {i} of many words") for i in range(50)])
    manifest = write_token_files(docs, vocabulary, new_folder(spark, "t"), layout=Format(frame_tokens=20)).collect()
    assert sum(m["n_docs"] for m in manifest) == 50
    seen = 0
    for m in manifest:
        reader = TokenFile(m["path"])
        frames = []
        plain = reader.frame
        reader.frame = lambda n, plain=plain, frames=frames: frames.append(n) or plain(n)
        for doc_id, ids in TokenFile(m["path"]).documents():
            frames.clear()
            assert reader.document(doc_id).tolist() == ids.tolist() and len(frames) == 1
            seen += 1
        for unknown in (-5, 10**9):
            with pytest.raises(KeyError):
                reader.document(unknown)
    assert seen == 50


def test_damage_is_found(spark):
    writer = FrameWriter(Format(frame_tokens=4))
    parts = [*writer.add([1, 2], np.arange(10, dtype=np.uint32), np.array([0, 5, 10])), *writer.close()]
    data = bytearray(b"".join(parts))
    path = f"{new_folder(spark, 'd')}/x"
    write_whole(path, [bytes(data)])
    assert [ids.tolist() for _, ids in TokenFile(path).documents()] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    data[12] ^= 0xFF
    write_whole(path, [bytes(data)])
    with pytest.raises(Exception):  # noqa: B017  either checksum may notice first
        list(TokenFile(path).documents())
    system, local = filesystem(path)
    assert system.get_file_info(local).size == len(data)
    with pytest.raises(ValueError, match="wide"):
        list(FrameWriter(Format(frame_tokens=1)).add([1], np.array([70_000], np.uint32), np.array([0, 1])))


def test_smallest_id_repeated_ids_and_long_texts(frame, spark, vocabulary):
    least = -(1 << 63)
    rows = [(least, "least"), (None, "none"), (None, None)] + [(5, f"copy {i % 3}") for i in range(300)] + [(8, "some words " * 150_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_token_files(frame(rows), vocabulary, new_folder(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(map(tuple, read_token_files(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, least] + [5] * 300 + [8]
    want = brute(rows, vocabulary)
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want) and got[-1][1:] == want[-1][1:]
    assert manifest.where("n_docs > 0").count() > 1  # copies of one id are dealt out
    reader = TokenFile(manifest.orderBy("shard").first()["path"])
    assert len(reader.document(least)) == got[2][2]
