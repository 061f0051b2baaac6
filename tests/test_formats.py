import lzma
import os

import pytest

from strandlog.sources import codec, crypto, files, store
from strandlog.sources.datasource import SegmentReader, SegmentSource

SEED = bytes(range(32))
ENTRIES = [(i, f"entry_{i}".encode()) for i in range(1, 4)]


def test_published_vectors():
    assert crypto.hkdf_sha256(b"\x0b" * 22, bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42, bytes.fromhex("000102030405060708090a0b0c")).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    block = crypto.chacha20_block(bytes(range(32)), 1, bytes.fromhex("000000090000004a00000000"))
    assert block.hex().startswith("10f1e7e4d13b5915500fdd1fa32071c4") and block.hex().endswith("b5129cd1de164eb9cbd083e8a2503c4e")
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert crypto.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert crypto.sign(seed, b"").hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"


def test_signatures():
    signature = crypto.sign(SEED, b"text")
    public = crypto.public_key(SEED)
    assert crypto.verify(public, b"text", signature)
    assert not crypto.verify(public, b"texT", signature) and not crypto.verify(public, b"text", bytes(64)) and not crypto.verify(b"\xff" * 32, b"text", signature)
    assert len(crypto.instance_id(SEED)) == 64


def test_file_keys_differ():
    keys = {crypto.file_key(SEED, q, f) for q in ("/a", "/b") for f in (1, 2, 256)}
    assert len(keys) == 6 and all(len(k) == 32 and len(n) == 12 for k, n in keys)
    assert crypto.file_key(SEED, "/a", 1) in keys


def test_wal_round_trip_and_damage():
    raw = codec.encode_wal(ENTRIES)
    assert list(codec.decode_wal(raw)) == ENTRIES
    assert len(raw) == 33 + sum(28 + len(d) for _, d in ENTRIES)
    assert list(codec.decode_wal(raw + os.urandom(50))) == ENTRIES
    assert list(codec.decode_wal(raw[:-1])) == ENTRIES[:2]
    broken = bytearray(raw)
    broken[-30] ^= 1
    assert len(list(codec.decode_wal(bytes(broken)))) == 2
    assert list(codec.decode_wal(b"")) == list(codec.decode_wal(raw[:20])) == list(codec.decode_wal(b"\1" * 64)) == []
    assert [i for i, _ in codec.decode_wal(codec.encode_wal([(i, b"") for i in range(20)]), 3, 12, 4)] == [3, 7, 11]


@pytest.mark.parametrize("n", [0, 255, 256, 2**16, 2**32, 2**64, 2**130])
def test_wide_ids(n):
    assert codec.read_number(codec.number(n), 0)[0] == n
    assert list(codec.decode_wal(codec.encode_wal([(n, b"x")]))) == [(n, b"x")] or n >= 2**128


def test_store_files():
    for kind in (codec.NONE, codec.ZSTD):
        header = codec.store_header(kind, codec.NONE, 1, 3)
        raw = codec.seal(header, codec.compress(codec.encode_wal(ENTRIES), kind), SEED)
        file = codec.open_store(raw, crypto.public_key(SEED))
        assert file.ids == (1, 3) and list(codec.decode_wal(codec.decompress(file.content, file.compression))) == ENTRIES
        for at in (160, len(raw) - 1):
            with pytest.raises(ValueError):
                codec.open_store(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :], crypto.public_key(SEED))
    with pytest.raises(ValueError):
        codec.compress(b"", codec.GZIP)


@pytest.mark.parametrize("compression, encryption", [(codec.NONE, codec.NONE), (codec.ZSTD, codec.AES)])
def test_tables_of_files(spark, compression, encryption):
    log = spark.range(50).selectExpr("if(id % 2 = 0, '/i/a', '/i/b') as queue", "id div 2 as entry_id", "cast(concat('x', id) as binary) as data")
    wal = files.encode_wal_files(log, 8)
    stored = files.to_store(wal, SEED, compression, encryption)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, stored.collect()))
    back = files.decode_wal_files(files.from_store(stored, SEED, verify=True))
    assert sorted((r.queue, r.entry_id, bytes(r.data)) for r in back.collect()) == sorted((r.queue, r.entry_id, bytes(r.data)) for r in log.collect())
    broken = stored.selectExpr("queue", "file_id", "if(file_id = 2, substring(content, 1, length(content) - 5), content) as content")
    assert {r.file_id for r in files.from_store(broken, SEED, verify=True).collect()} == {1, 3, 4}


def test_xz_is_read_and_a_missing_module_is_no_damage(spark, monkeypatch):
    raw = codec.seal(codec.store_header(codec.XZ, codec.NONE, 1, 3), lzma.compress(codec.encode_wal(ENTRIES)), SEED)
    stored = spark.createDataFrame([("/q", 1, bytearray(raw)), ("/q", 2, bytearray(raw[:-9])), ("/q", 3, bytearray(b""))], "queue string, file_id long, content binary")
    assert sorted((r.file_id, r.entry_id, bytes(r.data)) for r in files.decode_wal_files(files.from_store(stored, SEED, verify=False)).collect()) == [(1, *e) for e in ENTRIES]
    assert sorted(r.file_id for r in files.store_problems(stored, SEED).collect()) == [2, 3]
    assert [(r.file_id, r.status, r.first_id, r.last_id) for r in files.store_ranges(stored).orderBy("file_id").collect()] == [(1, "OK", 1, 3), (2, "OK", 1, 3), (3, "EMPTY", None, None)]
    with pytest.raises(Exception):
        files.from_store(stored, SEED, skip_corrupt=False).collect()


def test_store_jobs(spark, tmp_path):
    root = str(tmp_path)
    log = spark.range(60).selectExpr("if(id % 3 = 0, '/i/a', '/i/b') as queue", "id div 3 * 2 + id % 3 - if(id % 3 = 0, id div 3, 1) as entry_id", "cast(concat('x', id) as binary) as data")
    wal = files.encode_wal_files(log, 8).select("queue", "file_id", "content")
    wal = wal.union(spark.createDataFrame([("/i/b", 9, bytearray(codec.WalHeader(before=48).encode())), ("/i/b", 10, bytearray(codec.WalHeader(before=48).encode()))], wal.schema))
    files.write_files(wal, root, "wal").collect()
    stray = tmp_path / "i/a/wal/001.wal.abc.tmp"
    stray.write_bytes(b"half")
    ranges = store.compact_wal(spark, root, SEED)
    want = sorted((r.queue, r.entry_id, bytes(r.data)) for r in log.collect())
    names = lambda tier: sorted((r.queue, r.file_id) for r in files.list_files(spark, root, tier).collect())
    assert names("store") == sorted((r.queue, r.file_id) for r in ranges.collect()) == [("/i/a", 1), ("/i/a", 2), *(("/i/b", f) for f in range(1, 6))]
    assert names("wal") == [("/i/a", 3), ("/i/b", 10)]
    assert store.compact_wal(spark, root, SEED).count() == 0
    back = files.decode_wal_files(files.from_store(files.read_files(spark, root, "store"), SEED)).union(files.decode_wal_files(files.read_files(spark, root, "wal")))
    assert sorted((r.queue, r.entry_id, bytes(r.data)) for r in back.collect()) == want
    assert store.clean(spark, root) == 0 and store.clean(spark, root, -1) == 1 and not stray.exists()
    size = {(r.queue, r.file_id): r.bytes for r in store.sizes(spark, root).collect()}
    keep = sum(n for (q, f), n in size.items() if q == "/i/b" and f > 2)
    assert sorted((r.queue, r.file_id) for r in store.retain(spark, root, keep).collect()) == [("/i/b", 1), ("/i/b", 2)]
    assert {k for k in size if k not in {("/i/b", 1), ("/i/b", 2)}} == {(r.queue, r.file_id) for r in store.sizes(spark, root).collect()}
    store.truncate(spark, root, "/i/a")
    assert names("wal") == [("/i/b", 10)]
    assert files.delete_files(spark.createDataFrame([("/i/b", 10), ("/i/b", 77)], "queue string, file_id long"), root, "wal").orderBy("file_id").collect()[1].deleted is False


def test_seed_is_made_once(spark, tmp_path):
    seed = store.load_seed(spark, f"{tmp_path}/seed")
    assert len(seed) == 32 and store.load_seed(spark, f"{tmp_path}/seed") == seed
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(ValueError):
        store.load_seed(spark, f"{tmp_path}/short")


def test_bounds_leave_files_unread(tmp_path):
    for file_id in range(1, 6):
        path = tmp_path / f"q/wal/{file_id:03x}.wal"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(codec.encode_wal([(i, b"x") for i in range(10 * (file_id - 1), 10 * file_id)]))
    for first, last, want in ((0, None, 5), (25, 25, 1), (19, 20, 2), (45, None, 1), (0, 5, 1)):
        reader = SegmentReader({"path": str(tmp_path), "first": str(first)} | ({"last": str(last)} if last is not None else {}))
        parts = reader.partitions()
        assert sum(len(p.files) for p in parts) == want
        assert [r[2] for p in parts for r in reader.read(p)] == list(range(first, 50 if last is None else last + 1))


def test_data_source_and_listing(spark, tmp_path):
    for file_id, (lo, hi) in {"001": (0, 10), "fff": (10, 20), "001/000": (20, 30)}.items():
        path = tmp_path / "i/q/wal" / f"{file_id}.wal"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(codec.encode_wal([(i, str(i).encode()) for i in range(lo, hi)]))
    (tmp_path / "i/q/wal/note.wal").write_bytes(b"x")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)
    rows = spark.read.format("strandlog").load(str(tmp_path)).where("entry_id >= 8 and entry_id < 22")
    assert sorted((r.queue, r.file_id, r.entry_id, bytes(r.data)) for r in rows.collect()) == [("/i/q", 1 if i < 10 else 4095 if i < 20 else 4096, i, str(i).encode()) for i in range(8, 22)]
    step = spark.read.format("strandlog").option("first", 3).option("last", 15).option("step", 5).load(str(tmp_path))
    assert sorted(r.entry_id for r in step.collect()) == [3, 8, 13]
    assert sorted((r.queue, r.file_id) for r in files.list_files(spark, str(tmp_path), "wal").collect()) == [("/i/q", 1), ("/i/q", 4095), ("/i/q", 4096)]
    read = files.decode_wal_files(files.read_files(spark, str(tmp_path), "wal"), 5, 6)
    assert sorted(r.entry_id for r in read.collect()) == [5, 6]


def test_written_files_are_listed_and_read_back(spark, tmp_path):
    log = spark.range(40).selectExpr("if(id % 2 = 0, '/i/a', '/i/b') as queue", "id div 2 as entry_id", "cast(concat('x', id) as binary) as data")
    wal = files.encode_wal_files(log, 8).select("queue", "file_id", "content")
    assert files.write_files(wal, str(tmp_path), "wal").count() == 6
    listed = files.list_files(spark, str(tmp_path), "wal")
    assert sorted((r.queue, r.file_id) for r in listed.collect()) == [(q, f) for q in ("/i/a", "/i/b") for f in (1, 2, 3)]
    assert not list(tmp_path.rglob("*.tmp"))
    back = files.decode_wal_files(files.read_files(spark, str(tmp_path), "wal"))
    assert sorted((r.queue, r.entry_id, bytes(r.data)) for r in back.collect()) == sorted((r.queue, r.entry_id, bytes(r.data)) for r in log.collect())
    assert files.offload(wal, listed, str(tmp_path), "wal").count() == 0
    short = listed.selectExpr("queue", "file_id", "if(file_id = 2, bytes - 1, bytes) as bytes").where("file_id <> 3")
    assert sorted((r.queue, r.file_id) for r in files.offload(wal, short, str(tmp_path), "wal").collect()) == [(q, f) for q in ("/i/a", "/i/b") for f in (2, 3)]


def test_signing_and_verifying_double_nothing(monkeypatch):
    public, signature = crypto.public_key(SEED), crypto.sign(SEED, b"text")
    assert crypto.verify(public, b"text", signature)
    calls, plus = [], crypto._plus
    monkeypatch.setattr(crypto, "_plus", lambda p, q: calls.append(1) or plus(p, q))
    for i in range(5):
        assert crypto.verify(public, bytes(i), crypto.sign(SEED, bytes(i)))
    assert len(calls) < 10  # tables of a key's multiples are made once


def test_batches_of_files_are_bounded(spark):
    rows = ({"queue": "/q", "file_id": i, "content": bytes(1_000_000)} for i in range(20))
    sizes = [b.num_rows for b in files._batches(rows, ["queue", "file_id", "content"])]
    assert sum(sizes) == 20 and max(sizes) <= 5
    log = spark.range(300).selectExpr("'/q' as queue", "id as entry_id", "cast(concat('x', id) as binary) as data")
    wal = files.encode_wal_files(log, 8)
    plan = wal._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan  # entries come by in order; no file is held as a list of rows
    assert {(r.file_id, r.before, r.entries) for r in wal.collect()} == {(i + 1, 8 * i, min(8, 300 - 8 * i)) for i in range(38)}


def test_steps_share_a_worker_and_queues_of_any_name_are_listed(spark, tmp_path):
    log = spark.range(20).selectExpr("if(id % 2 = 0, '/_i/a b', '/i/wal/c') as queue", "id div 2 as entry_id", "cast(concat('x', id) as binary) as data")
    made = files.write_files(files.encode_wal_files(log, 4), str(tmp_path), "wal")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert made.count() == 6
    (tmp_path / "i/wal/c/wal/004.wal").write_bytes(b"")
    assert sorted((r.queue, r.file_id) for r in files.list_files(spark, str(tmp_path), "wal").collect()) == [(q, f) for q in ("/_i/a b", "/i/wal/c") for f in (1, 2, 3)]
    back = files.decode_wal_files(files.read_files(spark, str(tmp_path), "wal"))
    assert sorted((r.queue, r.entry_id, bytes(r.data)) for r in back.collect()) == sorted((r.queue, r.entry_id, bytes(r.data)) for r in log.collect())


@pytest.mark.parametrize("file_id, name", [(0, "000"), (4095, "fff"), (4096, "001/000"), (16777216, "001/000/000")])
def test_names_of_files(file_id, name):
    assert files._name(file_id, "wal") == f"{name}.wal"
