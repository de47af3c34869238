import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import chunking, codecs, transforms
from lodestone.functions.hashing import blake3
from lodestone.plans import planner
from lodestone.sources import container

BYTES = st.one_of(st.binary(max_size=600), st.lists(st.sampled_from([0, 1, 97, 255]), max_size=600).map(bytes))


@settings(max_examples=200, deadline=None)
@given(BYTES, st.sampled_from([1, 2, 4, 8]))
def test_transforms_are_undone(data, width):
    assert transforms.undo_delta(transforms.delta(data, width), width) == data
    assert transforms.undo_byte_split(transforms.byte_split(data, width), width) == data
    assert transforms.undo_rle(transforms.rle(data)) == data
    made, done = transforms.apply(data, [("delta", width), ("byte_split", width), ("rle", 0)])
    assert transforms.invert(made, done) == data


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5), st.booleans(), st.data())
def test_tables_are_undone(rows, columns, ended, draw):
    field = st.text("ab1 ", max_size=4).map(str.encode)
    data = b"\n".join(b";".join(draw.draw(field) for _ in range(columns)) for _ in range(rows)) + b"\n" * ended
    assert transforms.undo_csv_columnar(transforms.csv_columnar(data, b";")) == data


@settings(max_examples=60, deadline=None)
@given(BYTES, st.sampled_from([c[0] for c in codecs.CATALOG]))
def test_codecs_decode_within_their_limit(data, codec):
    packed = codecs.encode(data, codec, 3 if codec == "xz" else None)
    assert codecs.decode(packed, codec, len(data), length=len(data)) == data
    if len(data) > 1:
        with pytest.raises(codecs.CodecError):
            codecs.decode(packed, codec, len(data) - 1, length=len(data))


def test_a_bomb_is_refused():
    for codec in ("zstd", "deflate", "bzip2", "xz"):
        packed = codecs.encode(bytes(50_000_000), codec, 1)
        with pytest.raises(codecs.CodecError):
            codecs.decode(packed, codec, 1 << 20)


def test_levels_and_names():
    assert codecs.named("lzma") == "xz" and codecs.checked_level("zstd", None) == 10 and codecs.label("lz4", 0) == "lz4"
    with pytest.raises(codecs.CodecError):
        codecs.checked_level("deflate", 10)


def test_blake3_gives_the_published_digests():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert blake3(bytes(i % 251 for i in range(1025))).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


def test_chunks_cover_and_survive_an_insertion():
    import random

    data = random.Random(5).randbytes(300_000)
    chunks = chunking.cdc(data, 4096)
    assert b"".join(data[a : a + n] for a, n in chunks) == data
    assert all(n <= 8 * 4096 for _, n in chunks) and all(n > 1024 for _, n in chunks[:-1])
    edited = data[:150_000] + b"new bytes" + data[150_000:]
    old = {data[a : a + n] for a, n in chunks}
    kept = sum(n for a, n in chunking.cdc(edited, 4096) if edited[a : a + n] in old)
    assert kept > 0.85 * len(data)


def test_block_file_reads_at_random_and_finds_flips():
    data = b"".join(b"%d,%d,x\n" % (i, i * i) for i in range(4000))
    packed = container.write_blocks((data[a : a + n] for a, n in chunking.fixed(data, 4096)), 12)
    _, blocks = container.read_table(packed)
    assert b"".join(container.read_block(packed, b) for b in blocks) == data
    assert container.read_block(packed, blocks[3]) == data[3 * 4096 : 4 * 4096]
    for place in range(0, len(packed), 997):
        broken = bytearray(packed)
        broken[place] ^= 1
        try:
            assert container.corrupted(bytes(broken))
        except container.ContainerError:
            pass


def test_envelopes_restore_or_say_why():
    data = bytes(range(256)) * 40
    for label in ("stored", "lz4", "rle+zstd:3", "delta:8>byte_split:8+xz:3", "brotli:5"):
        sealed = container.seal(data, label)
        assert container.unseal(sealed) == data
        with pytest.raises(container.ContainerError) as e:
            container.unseal(sealed[:-1] + bytes([sealed[-1] ^ 1]))
        assert e.value.code == "payload_hash"
    with pytest.raises(container.ContainerError):
        container.unseal(container.seal(data, "zstd:3"), most=100)


def test_candidates_end_with_stored_and_keep_their_budget():
    for klass in planner.PLANS:
        for effort, most in planner.BUDGET.items():
            plans = planner.candidates(klass, effort, entropy=1.0, dictionary=True)
            assert "stored" in plans and len(plans) <= most + 1 and len(set(plans)) == len(plans)
    assert planner.candidates("numeric_binary", "max", stride=2)[-3:] == ["byte_split:4+zstd:19", "byte_split:8+zstd:19", "stored"]
    assert planner.candidates("tabular", "balanced")[:2] == ["zstd:12", "csv_columnar+zstd:12"]


def test_probe_and_dictionary():
    import random

    assert codecs.looks_incompressible(random.Random(1).randbytes(1 << 16)) and not codecs.looks_incompressible(b"some text " * 5000)
    assert codecs.train_dictionary([b"short"] * 20) is None
    samples = [b'{"ts": %d, "user": "u%d", "event": "view"}' % (i * 7919, i % 97) * 60 for i in range(200)]
    assert codecs.train_dictionary(samples)
