"""Files of several tracks."""

import struct

from ledgerlens.llm import media


def body(data, *path):
    return next(data[a:b] for p, a, b in media.boxes(data) if p == path)


def test_each_track_has_its_own_tables():
    first, second = bytes(range(64)) * 20, bytes(range(100, 164)) * 33
    files = [media.encode(x) for x in (first, second)]
    traks = [body(x, b"moov", b"trak") for x in files]
    traks[0] = traks[0].replace(b"stss", b"free")  # all samples of the first track are keyframes
    head = len(body(files[0], b"ftyp")) + 8 + 8 + sum(len(x) + 8 for x in traks) + 8
    for i, (trak, start) in enumerate(zip(traks, (head, head + len(first)))):
        at = trak.index(b"stco") + 8
        n = struct.unpack_from(">I", trak, at)[0]
        offsets = [start + k * 64 * 64 for k in range(n)]
        traks[i] = trak[: at + 4] + struct.pack(f">{n}I", *offsets) + trak[at + 4 + 4 * n :]
    whole = media._box(b"ftyp", body(files[0], b"ftyp")) + media._box(b"moov", *[media._box(b"trak", x) for x in traks]) + media._box(b"mdat", first, second)
    info, back = media.read(whole)
    assert back == first + second and len(info["tracks"]) == 2
    assert info["keys"].tolist() == list(range(20)) and info["tracks"][1]["keys"].tolist() == [0, 16, 32]
    for track, payload in zip(info["tracks"], (first, second)):
        assert track["codec"] == "raw " and track["duration"] == len(payload) / 8000
        assert all(whole[o : o + 64] == payload[k * 64 : k * 64 + 64] for k, o in zip(track["keys"], track["offsets"][track["keys"]]))


def fragmented(payload, runs, *, base="fragment", own_sizes=False):
    """A file whose samples lie in fragments of ``runs`` frames each; every fourth frame of a run is a keyframe."""
    whole = media.encode(payload[:64])
    kind, movie = (body(whole, x) for x in (b"ftyp", b"moov"))
    at = {}
    for path, a, b in media.boxes(whole):
        at[path[-1]] = (a, b)
    movie = bytearray(whole[at[b"moov"][0] : at[b"moov"][1]])
    shift = at[b"moov"][0]
    for name, size in ((b"stts", 8), (b"stss", 8), (b"stsc", 8), (b"stco", 8)):  # no samples in the movie itself
        a, _ = at[name]
        movie[a - shift + 4 : a - shift + 8] = bytes(4)
    a, _ = at[b"stsz"]
    movie[a - shift + 4 : a - shift + 12] = bytes(8)
    a, _ = at[b"mdhd"]
    movie[a - shift + 16 : a - shift + 20] = bytes(4)
    trex = media._full(b"trex", 0, struct.pack(">5I", 1, 1, 64, 64, 0x10000))
    out = media._box(b"ftyp", kind) + media._box(b"moov", bytes(movie), media._box(b"mvex", trex))
    done = 0
    for k, n in enumerate(runs):
        frames = payload[done * 64 : (done + n) * 64]

        def moof(offset):
            flags = 0x20000 if base == "fragment" else 0x1 if base == "file" else 0
            header = media._full(b"tfhd", flags, struct.pack(">I", 1), struct.pack(">Q", len(out)) if base == "file" else b"")
            time = media._full(b"tfdt", 0, struct.pack(">I", done * 64))
            says = [0 if i % 4 == 0 else 0x10000 for i in range(n)]
            sample = (lambda i: struct.pack(">III", 64, 64, says[i])) if own_sizes else (lambda i: struct.pack(">I", says[i]))
            flags = 0x701 if own_sizes else 0x401
            run = media._full(b"trun", flags, struct.pack(">Ii", n, offset), *[sample(i) for i in range(n)])
            return media._box(b"moof", media._full(b"mfhd", 0, struct.pack(">I", k + 1)), media._box(b"traf", header, time, run))

        head = moof(0)
        out += moof(len(head) + 8) + media._box(b"mdat", frames)
        done += n
    return out


def test_fragments_are_read():
    payload = bytes(i * 7 % 251 for i in range(64 * 23))
    for base in ("fragment", "file", "next"):
        for own in (False, True):
            data = fragmented(payload, [5, 1, 17], base=base, own_sizes=own)
            info, back = media.read(data)
            assert back == payload and info["duration"] == len(payload) / 8000 and info["codec"] == "raw "
            assert info["keys"].tolist() == [0, 4, 5, 6, 10, 14, 18, 22]
            assert all(data[o : o + 64] == payload[k * 64 : k * 64 + 64] for k, o in zip(info["keys"], info["offsets"][info["keys"]]))


def test_a_first_sample_of_its_own_and_runs_without_offset():
    payload = bytes(range(64)) * 6
    data = bytearray(fragmented(payload, [6]))
    a = data.index(b"trun") + 4
    first = media._full(b"trun", 0x5, struct.pack(">Iii", 4, 0, 0)) + media._full(b"trun", 0, struct.pack(">I", 2))
    traf, moof = data.index(b"traf") - 4, data.index(b"moof") - 4
    old = struct.unpack_from(">I", data, a - 8)[0]
    grown = len(first) - old
    offset = struct.unpack_from(">I", data, moof)[0] + grown + 8
    first = media._full(b"trun", 0x5, struct.pack(">Iii", 4, offset, 0)) + media._full(b"trun", 0, struct.pack(">I", 2))
    for at in (traf, moof):
        struct.pack_into(">I", data, at, struct.unpack_from(">I", data, at)[0] + grown)
    data[a - 8 : a - 8 + old] = first
    info, back = media.read(bytes(data))
    assert back == payload and info["keys"].tolist() == [0]


def test_broken_fragments_raise():
    import pytest

    data = fragmented(bytes(64 * 9), [4, 5])
    for cut in (10, 64 * 5, 64 * 5 + 60):
        with pytest.raises(ValueError):
            media.probe(data[:-cut])


def test_clashing_columns_give_way(spark):
    from ledgerlens.llm.common import tuned

    tuned(spark)
    docs = spark.createDataFrame([(1, "abc", "x", 7)], "doc_id long, text string, Feature string, codec int")
    out = media.media_columns(docs)
    assert out.columns == ["doc_id", *media.COLUMNS] and out.first()["n_bytes"] == 3
