import os
import random
from threading import Thread

import pytest

from quarrystone.config import NO_PROVIDER, NO_REUSE, NOT_PERSISTED, NOTHING_TO_REUSE, CHUNK_COUNT_BUDGET, ChunkingConfig, EngineError, FileQuery, IndexConfig, MemoryBudget, RecordIndexConfig, RecordQuery
from quarrystone.functions.frames import shared_dir
from quarrystone.operators import baselines
from quarrystone.operators.files import FileIndex
from quarrystone.operators.postings import id_ranges
from quarrystone.operators.store import Generations, RecordIndex
from quarrystone.sources.crawl import Folder, head_commit
from quarrystone.sources.providers import CallableProvider, records_frame

R1 = dict(id="r1", collection="messages", title="Sparse indexing", body="This chat memory uses sparse indexing for fast lookup.", tags=["memory", "chat"], metadata={"conversation": "alpha"})
R2 = dict(id="r2", collection="notes", body="Project notes mention BackgroundTasks compaction for the index.", tags=["notes"], metadata={"project": "ios"})


def found(index, text, **options):
    by_scan = index.search(RecordQuery(text, **options))[1].first().matched_record_count
    assert index.search(RecordQuery(text, **options), "indexed")[1].first().matched_record_count == by_scan
    return by_scan


def test_life_of_an_index(spark, tmp_path):
    config = RecordIndexConfig(storage=str(tmp_path / "ix"))
    index = RecordIndex(spark, config)
    assert index.upsert(records_frame(spark, [])).upserted == 0
    assert index.upsert(records_frame(spark, [R1, R2])).upserted == 2
    s = index.status().first()
    assert s.record_count == 2 and s.chunk_count == 3
    hits, report = index.search(RecordQuery("sparse indexing", collections=("messages",)))
    assert report.first().matched_record_count == 1 and {r.record_id for r in hits.collect()} == {"r1"}
    index.upsert(records_frame(spark, [dict(R1, body="first"), dict(R1, body="This chat memory now uses hashed ngrams for recall.")]))
    assert (found(index, "fast lookup"), found(index, "hashed ngrams"), found(index, "Sparse")) == (0, 1, 1)
    assert index.delete(["r2", "absent"], "messages").deleted == 0
    assert index.delete(["r2"], "notes").deleted == 1
    assert found(index, "BackgroundTasks") == 0
    again = RecordIndex(spark, config)  # read again without compaction: nothing that was replaced comes back
    assert (found(again, "fast lookup"), found(again, "hashed ngrams"), found(again, "BackgroundTasks")) == (0, 1, 0)
    assert again.compact().compacted
    s = again.status().first()
    assert (s.record_count, s.overlay_chunk_count, s.tombstone_count) == (1, 0, 0)
    assert found(RecordIndex(spark, config), "hashed ngrams") == 1
    assert len(os.listdir(tmp_path / "ix" / "generations")) <= 2


def test_delete_in_all_collections_and_ids_never_come_back(spark, tmp_path):
    index = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "ix")))
    index.replace_all(records_frame(spark, [R1, dict(R1, collection="notes"), R2, R2]))
    assert index.status().first().chunk_count == 6  # equal keys are all kept
    top = index.chunks().agg({"chunk_id": "max"}).first()[0]
    assert index.delete(["r1"]).deleted == 2
    index.upsert(records_frame(spark, [R1]))
    assert index.chunks().where("record_id = 'r1'").agg({"chunk_id": "min"}).first()[0] > top


def test_compaction_threshold_and_budget(spark, tmp_path):
    index = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "a"), compaction_threshold=3))
    assert not index.upsert(records_frame(spark, [R2])).compacted
    assert index.upsert(records_frame(spark, [R1])).compacted
    index = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "b"), chunking=ChunkingConfig(256, 0), budget=MemoryBudget(max_resident_bytes=512, max_chunks=1)))
    with pytest.raises(EngineError) as e:
        index.upsert(records_frame(spark, [dict(id="x", collection="c", body="chunk " * 85)]))
    assert e.value.code == CHUNK_COUNT_BUDGET and index.status().first().chunk_count == 0
    with pytest.raises(EngineError):
        index.replace_all(records_frame(spark, [dict(id="x", collection="c", body="chunk " * 200)]))
    assert index.status().first().chunk_count == 0


def test_two_writers_keep_both(spark, tmp_path):
    config = RecordIndexConfig(storage=str(tmp_path / "ix"))
    one, two = RecordIndex(spark, config), RecordIndex(spark, config)
    one.upsert(records_frame(spark, [dict(R1, id="one")]))
    two.upsert(records_frame(spark, [dict(R1, id="two")]))
    one.delete(["two"], "notes")
    one.upsert(records_frame(spark, [dict(R1, id="three")]))
    two.compact()
    chunks = RecordIndex(spark, config).chunks().collect()
    assert {r.record_id for r in chunks} == {"one", "two", "three"} and len({r.chunk_id for r in chunks}) == len(chunks)


def test_writers_at_the_same_time(spark, tmp_path):
    config = RecordIndexConfig(storage=f"file://{tmp_path}/ix")
    RecordIndex(spark, config)
    failed = []

    def write(k):
        try:
            RecordIndex(spark, config).upsert(records_frame(spark, [dict(R1, id=f"r{k}")]))
        except Exception as e:
            failed.append(e)

    threads = [Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and {r.record_id for r in RecordIndex(spark, config).chunks().collect()} == {"r0", "r1", "r2"}


def test_lock_of_a_dead_writer(spark, tmp_path, monkeypatch):
    store = Generations(spark, str(tmp_path / "s"))
    assert store._renamed(store._put("dead"), "LOCK", overwrite=False)
    assert not store._renamed(store._put("other"), "LOCK", overwrite=False) and not store._claimed("other")
    os.utime(tmp_path / "s" / "LOCK", (1, 1))
    with store.locked():
        assert store._holds(store._token)
    assert not (tmp_path / "s" / "LOCK").exists()
    with store.locked(), pytest.raises(OSError, match="lost"):
        (tmp_path / "s" / "LOCK").unlink()
        store._write_current({})


def test_candidates_narrow_the_scan(spark, tmp_path, monkeypatch):
    """Files of a store that hold no candidate are not read, and pages of the others are chosen by id."""
    rows = [dict(id=f"{k:05d}", collection="c", body=f"record {k} " + ("needle" if k in (70, 71, 3000) else "straw")) for k in range(4000)]
    index = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "ix")))
    index.replace_all(records_frame(spark, rows))
    hits = index.search(RecordQuery("needle", smart_case=False), "indexed")[0]
    assert {r.record_id for r in hits.collect()} == {"00070", "00071", "03000"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    again = index.search(RecordQuery("needle", smart_case=False), "indexed")[0]
    plan = spark._jvm.PythonSQLUtils.explainString(again._jdf.queryExecution(), "formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters" in plan and "LessThanOrEqual(chunk_id,71)" in plan and "Join" not in plan
    monkeypatch.setattr("quarrystone.operators.postings.IN_FILTER", 1)
    assert {r.record_id for r in index.search(RecordQuery("needle", smart_case=False), "indexed")[0].collect()} == {"00070", "00071", "03000"}
    monkeypatch.setattr("quarrystone.operators.postings.FEW", 1)
    assert index.search(RecordQuery("needle", smart_case=False), "indexed")[1].first().candidate_chunk_count == 3
    assert index.search(RecordQuery("absent7", smart_case=False), "indexed")[1].first().candidate_chunk_count == 0
    assert id_ranges([1, 2, 3, 50, 51, 900], 2) == [(1, 51), (900, 900)] and id_ranges([5]) == [(5, 5)] and id_ranges([]) == []


def test_disk_of_an_index(spark, tmp_path, monkeypatch):
    """At every publishing, little lies in the shared folder besides: no copy of the postings, none of texts that are
    written; a delete copies no overlay, and what was held is gone."""
    pick = random.Random(3)
    words = ["".join(pick.choices("abcdefghijklmnop", k=5)) for _ in range(400)]
    rows = [dict(id=f"{k:05d}", collection=f"c{k % 3}", body=" ".join(pick.choices(words, k=60))) for k in range(1500)]
    shared = shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{at}/{f}") for at, _, fs in os.walk(shared) for f in fs)
    besides, before, write = [], size(), Generations._write_current
    monkeypatch.setattr(Generations, "_write_current", lambda self, meta: (besides.append(size() - before), write(self, meta))[1])
    index = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "ix")))
    index.replace_all(records_frame(spark, rows))
    index.upsert(records_frame(spark, [dict(r, body=r["body"] + " needle") for r in rows[:90]]))
    assert index.delete([r["id"] for r in rows[60:70]]).deleted == 10 and index.delete(["00100"]).deleted == 1
    assert len(list((tmp_path / "ix").glob("generations/*/overlay-*/postings"))) == 1
    again = RecordIndex(spark, RecordIndexConfig(storage=str(tmp_path / "ix")))
    assert found(again, "needle") == 80 and again.status("chunk_count", "overlay_chunk_count").first()[:2] == (1489, 90)
    again.upsert(records_frame(spark, [dict(rows[61], body="needle")]))
    again.compact()
    assert found(again, "needle") == 81 and found(again, words[0]) > 80
    assert [r.chunk_id for r in again.chunks().orderBy("collection", "record_id").collect()] == list(range(1490))
    assert max(besides) < 2 * again.postings().count() and not [f for f in os.listdir(shared) if f.startswith("held-")]


def test_recovery(spark, tmp_path):
    memo = dict(id="memo-1", collection="memories", body="A persisted memory about sparse indexing.", tags=["memory"])
    provider = CallableProvider(lambda s: [memo])
    path = str(tmp_path / "ix")
    RecordIndex(spark, RecordIndexConfig(storage=path), provider).rebuild()

    def damage():
        (tmp_path / "ix" / "CURRENT").write_text("{not valid json")
        (tmp_path / "ix" / ".CURRENT.crc").unlink(missing_ok=True)

    damage()
    with pytest.raises(Exception, match="."):
        RecordIndex(spark, RecordIndexConfig(storage=path, recovery="fail"))
    with pytest.raises(EngineError) as e:
        RecordIndex(spark, RecordIndexConfig(storage=path))
    assert e.value.code == NO_PROVIDER
    index = RecordIndex(spark, RecordIndexConfig(storage=path), provider)
    assert index.status().first().record_count == 1 and found(index, "sparse indexing") == 1
    damage()
    assert RecordIndex(spark, RecordIndexConfig(storage=path, recovery="discard")).status().first().record_count == 0
    with pytest.raises(EngineError):
        RecordIndex(spark, RecordIndexConfig(storage=path)).rebuild()


def test_benchmark_of_records(spark, tmp_path):
    rows = [dict(id="msg-1", collection="messages", title="SearchEngine memory", body="Sparse indexing keeps local app memory searchable.", tags=["memory"]), dict(id="msg-2", collection="messages", body="The actor-backed index supports fast lookup.", tags=["memory"])]
    df, q, config = records_frame(spark, rows), RecordQuery("SearchEngine"), RecordIndexConfig(storage=str(tmp_path / "ix"))
    with pytest.raises(EngineError) as e:
        baselines.benchmark_records(spark, df, q, config, reuse=True)
    assert e.value.code == NOTHING_TO_REUSE
    phases = []
    first = {r.engine: r for r in baselines.benchmark_records(spark, df, q, config, progress=lambda p, m: phases.append(p)).collect()}
    again = {r.engine: r for r in baselines.benchmark_records(spark, df, q, config, reuse=True).collect()}
    assert len(first) == 5 and {r.matched_records for r in first.values()} == {1} == {r.matched_records for r in again.values()}
    assert first["scan"].speedup == 1 and first["index"].speedup > 0
    assert again["index"].build_ms == 0 and phases[0] == "prepare" and phases[-1] == "done"
    with pytest.raises(EngineError) as e:
        baselines.benchmark_records(spark, df, q, reuse=True)
    assert e.value.code == NO_REUSE


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for path, text in {
        "Sources/App/SearchEngine.swift": 'struct SearchEngine {\n    let marker = "sparse-index"\n}', "Sources/App/Parser.swift": "enum Parser { }", "README.md": "SearchEngine ships as an example",
        "_u.txt": "SearchEngine", ".hid/x.txt": "SearchEngine", ".build/x.txt": "SearchEngine", "a.tmp": "SearchEngine", "keep.tmp": "plain", ".gitignore": "*.tmp\n!keep.tmp\nout/\n", "out/y.txt": "SearchEngine",
        "sub/.gitignore": "/n.txt\n", "sub/n.txt": "SearchEngine", "sub/deep/n.txt": "SearchEngine", "sub/m.txt": "SearchEngine", "big.txt": "x" * 2000,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bin.dat").write_bytes(b"SearchEngine\0")
    os.symlink(root / "README.md", root / "link.md")
    return root


CONFIG = IndexConfig(max_file_bytes=1000)
SEEN = [".gitignore", "README.md", "Sources/App/Parser.swift", "Sources/App/SearchEngine.swift", "_u.txt", "keep.tmp", "sub/.gitignore", "sub/m.txt"]


def paths(index):
    return [r.relative_path for r in index.files.orderBy("doc_id").collect()]


def test_crawl_of_many_rounds(spark, tree, monkeypatch):
    monkeypatch.setattr("quarrystone.sources.crawl.WALK", 1)
    monkeypatch.setattr("quarrystone.sources.crawl.READ_BYTES", 1)
    assert paths(FileIndex.build(spark, f"file://{tree}", CONFIG)) == SEEN
    os.symlink(tree, tree / "sub" / "loop")
    found = paths(FileIndex.build(spark, str(tree), IndexConfig(max_file_bytes=1000, follow_symlinks=True)))
    assert "link.md" in found and not any("loop" in p for p in found)


def test_crawl_by_address(tree):
    """What pyarrow lists of a folder is what the mounted one holds, but for links."""
    here, there = Folder(str(tree)), Folder(str(tree))
    from pyarrow import fs

    there.remote = fs.LocalFileSystem()
    entries = lambda f: {e[:3] for e in f.entries("") if e[0] != "link.md"}
    assert {(n, d, 0 if d else s) for n, d, s in entries(there)} == entries(here)
    assert there.read("README.md", 6) == here.read("README.md", 6) == b"Search" and there.read("absent") is None


def test_crawl(spark, tree):
    assert paths(FileIndex.build(spark, str(tree), CONFIG)) == SEEN
    more = FileIndex.build(spark, str(tree), IndexConfig(include_hidden=True, respect_ignore_files=False, follow_symlinks=True, skipped_directories=()))
    assert {".hid/x.txt", ".build/x.txt", "a.tmp", "big.txt", "link.md", "sub/n.txt", "out/y.txt"} <= set(paths(more)) and "bin.dat" not in paths(more)
    with pytest.raises(EngineError) as e:
        more.status()
    assert e.value.code == NOT_PERSISTED


def test_file_index_round_trip_and_update(spark, tree, tmp_path):
    where = str(tmp_path / "fx")
    index = FileIndex.create(spark, str(tree), where, CONFIG)
    assert index.status().first().file_count == len(SEEN)
    for strategy in ("scan", "indexed"):
        s = index.search("Search.*Engine|SearchE", FileQuery(), strategy)
        assert {r.relative_path for r in s.counts().collect()} == {"README.md", "Sources/App/SearchEngine.swift", "_u.txt", "sub/m.txt"}
    assert index.search("SearchEngine", FileQuery(), "indexed").report().first().candidate_count < len(SEEN)
    generation = index.meta["generation"]
    (tree / "README.md").write_text("now something else, longer")
    (tree / "New.swift").write_text('let token = "sparse-index"')
    (tree / "_u.txt").unlink()
    index = FileIndex.update(spark, str(tree), where, CONFIG)
    assert index.meta["generation"] == generation
    status = index.status().first()
    assert (status.overlay_file_count, status.tombstone_count, status.commit) == (2, 2, None) and 0 <= status.age_seconds < 600
    assert sorted(paths(index)) == sorted([*(p for p in SEEN if p != "_u.txt"), "New.swift"])
    for strategy in ("scan", "indexed"):
        assert {r.relative_path for r in index.search("sparse-index", FileQuery(literal=True), strategy).counts().collect()} == {"New.swift", "Sources/App/SearchEngine.swift"}
        assert index.search("example", FileQuery(), strategy).report().first().matched_file_count == 0
    other = FileIndex.update(spark, str(tree), where, IndexConfig(max_file_bytes=1000, max_gram_length=16))
    assert other.meta["generation"] != generation
    assert paths(FileIndex.open(spark, where)) == paths(other)
    with pytest.raises(EngineError):
        FileIndex.open(spark, str(tmp_path / "nowhere"))


def test_head_commit(tmp_path):
    assert head_commit(str(tmp_path)) is None
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git" / "refs" / "heads" / "main").write_text("abc123\n")
    assert head_commit(str(tmp_path)) == "abc123"
    (tmp_path / ".git" / "refs" / "heads" / "main").unlink()
    (tmp_path / ".git" / "packed-refs").write_text("# pack-refs with: peeled\nfff000 refs/heads/other\ndef456 refs/heads/main\n")
    assert head_commit(str(tmp_path)) == "def456"
    work = tmp_path / ".git" / "worktrees" / "w"
    work.mkdir(parents=True)
    (work / "HEAD").write_text("ref: refs/heads/other\n")
    (work / "commondir").write_text("../..\n")
    (tmp_path / "linked").mkdir()
    (tmp_path / "linked" / ".git").write_text(f"gitdir: {work}\n")
    assert head_commit(str(tmp_path / "linked")) == "fff000"


def test_benchmark_of_files(spark, tmp_path):
    for n in range(40):
        p = tmp_path / "b" / "Sources" / f"File{n}.swift"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join('let benchmarkNeedle = "SearchEngine"' if (n, k) == (17, 12) else f'let value{k} = "file-{n}-line-{k}"' for k in range(25)))
    r = baselines.benchmark_files(spark, str(tmp_path / "b"), "SearchEngine").first()
    assert r.file_count == 40 and r.indexed_matches == r.scan_matches == 1


def test_index_without_storage_lives_in_the_shared_folder(spark):
    index = RecordIndex(spark)
    index.upsert(records_frame(spark, [R1]))
    index.upsert(records_frame(spark, [R2]))
    assert index.status().first().record_count == 2 and "://" in index.store.path
    index.remove()
