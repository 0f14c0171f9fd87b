"""Runs of the store: a stop at any point, two writers at once, claims that expire, and a file system that is not ``file:``."""
from __future__ import annotations

import collections
import threading
import time

import pytest

from conftest import clip, export, frame_rows
from framefold.operators.profile import videos
from framefold.plans.ingest import STATUS_TAKEN, PartitionConflictError, ingest, ingest_rows
from framefold.sources import runs as RN
from framefold.sources.csv_scan import read_frames_csv
from framefold.sources.files import StoreFiles
from framefold.sources.store import ManifestStore

CLIPS = {(c, k, f"{c}{k}{i}"): 2 + i for c in ("Q7", "Z2") for k in ("bow", "keel") for i in range(3)}


class Stop(RuntimeError):
    pass


def exports(folder) -> str:
    return export(folder, "all.csv", [r for (c, k, v), n in CLIPS.items() for r in frame_rows(clip(c, k, v), range(n))])


def stored(spark, root) -> tuple[dict, dict]:
    st = ManifestStore(spark, str(root))
    return ({(r.cruise, r.camera, r.video_id): r.frame_count for r in st.read_videos().collect()},
            dict(collections.Counter((r.cruise, r.video_id) for r in st.read_frames().collect())))


WHOLE = (CLIPS, {(c, v): n for (c, _, v), n in CLIPS.items()})


def stop_after(n: int):
    moved = []

    def on_move(source: str, target: str) -> None:
        if len(moved) == n:
            raise Stop
        moved.append(target)
    return on_move


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_a_stop_between_two_renames_is_finished_by_the_next_run(spark, tmp_path, n):
    root, path = str(tmp_path / "s"), exports(tmp_path)
    with pytest.raises(Stop):
        ingest_rows(spark, read_frames_csv(spark, [path]), root, frames=True, on_move=stop_after(n))
    whole = collections.Counter((c, k) for c, k, _ in CLIPS)
    seen = collections.Counter((c, k) for c, k, _ in stored(spark, root)[0])
    assert all(seen[p] == whole[p] for p in seen), "a partition of videos is there whole or not at all"
    assert len(seen) == max(0, n - 2), "frames of both cruises come first"
    report = ingest(spark, [path], root, frames=True, skip_existing=True)
    assert list(report.recovered.values()) == ["published"] and report.summary.first().status == "nothing_new"
    assert stored(spark, root) == WHOLE
    assert StoreFiles(spark, root).names("_staging") == []


def test_a_stop_inside_frames_that_join_an_older_folder(spark, tmp_path):
    root = str(tmp_path / "s")
    first = export(tmp_path, "first.csv", [r for (c, k, v), n in CLIPS.items() if k == "bow" for r in frame_rows(clip(c, k, v), range(n))])
    ingest(spark, [first], root, frames=True)
    with pytest.raises(Stop):
        ingest_rows(spark, read_frames_csv(spark, [exports(tmp_path)]), root, frames=True, skip_existing=True, on_move=stop_after(1))
    ingest(spark, [exports(tmp_path)], root, frames=True, skip_existing=True)
    assert stored(spark, root) == WHOLE


def test_a_stop_before_the_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    root, path = str(tmp_path / "s"), exports(tmp_path)
    real = RN.Run.stage

    def fails(self, table, rows, observation=None):
        if table == "videos":
            raise Stop
        real(self, table, rows, observation)
    monkeypatch.setattr(RN.Run, "stage", fails)
    with pytest.raises(Stop):
        ingest(spark, [path], root, frames=True)
    assert stored(spark, root) == ({}, {})
    monkeypatch.setattr(RN.Run, "stage", real)
    report = ingest(spark, [path], root, frames=True)
    assert report.recovered == {} and StoreFiles(spark, root).names("_staging") == []
    assert (report.summary.first().frames_written, stored(spark, root)) == (sum(CLIPS.values()), WHOLE)
    assert set(report.seconds) == {"recover", "profile", "plan", "claim", "frames", "videos", "commit"}


@pytest.mark.parametrize("end", ["published", "rolled back"])
def test_a_killed_driver_is_recovered_once_its_claims_expire(spark, tmp_path, end):
    root, path = str(tmp_path / "s"), exports(tmp_path)
    store = ManifestStore(spark, root)
    dead = RN.Run(store, claim_seconds=3600).__enter__()
    dead.claim([("Q7", "bow")])
    dead.stage("videos", videos(read_frames_csv(spark, [path])).filter("cruise = 'Q7' AND camera = 'bow'"))
    if end == "published":
        RN.mark_staged(store.files, dead.id)
    dead.claims._ended.set()
    with pytest.raises(PartitionConflictError):
        ingest(spark, [path], root, frames=True)
    report = ingest(spark, [path], root, frames=True, skip_existing=True)
    assert {(r.cruise, r.camera) for r in report.plan.collect() if r.status == STATUS_TAKEN} == {("Q7", "bow")} and not report.recovered
    store.files.replace(dead.claims.lease, '{"expires": 0}')
    report = ingest(spark, [path], root, skip_existing=True)
    assert report.recovered == {dead.id: end} and stored(spark, root)[0] == CLIPS


def test_two_ingests_at_once_write_every_row_once(spark, tmp_path):
    root, path = str(tmp_path / "s"), exports(tmp_path)
    holding, go_on = threading.Event(), threading.Event()

    def waits(source, target):
        holding.set()
        assert go_on.wait(300)
    out = {}

    def first():
        out["first"] = ingest_rows(spark, read_frames_csv(spark, [path]), root, frames=True, on_move=waits).summary.first()
    thread = threading.Thread(target=first)
    thread.start()
    try:
        assert holding.wait(300)
        with pytest.raises(PartitionConflictError, match="4 ") as err:
            ingest(spark, [path], root, frames=True)
        assert {r.status for r in err.value.plan.collect()} == {STATUS_TAKEN}
        second = ingest(spark, [path], root, frames=True, skip_existing=True).summary.first()
    finally:
        go_on.set()
        thread.join()
    assert (out["first"].status, out["first"].videos_written) == ("written", len(CLIPS))
    assert (second.status, second.partitions_skipped, second.videos_written) == ("nothing_new", 4, 0)
    assert stored(spark, root) == WHOLE


def test_what_was_stored_after_the_plan_is_not_written_again(spark, tmp_path, monkeypatch):
    root, path = str(tmp_path / "s"), exports(tmp_path)
    real = ManifestStore.existing_partitions

    def late(self):
        found = real(self)
        monkeypatch.setattr(ManifestStore, "existing_partitions", real)
        ingest(spark, [path], root, frames=True)  # another run, whole, between the plan and the claim
        return spark.createDataFrame([], found.schema)
    monkeypatch.setattr(ManifestStore, "existing_partitions", late)
    assert ingest(spark, [path], root, frames=True, skip_existing=True).summary.first().status == "nothing_new"
    assert stored(spark, root) == WHOLE


def test_one_of_many_gets_a_claim(spark, tmp_path):
    files = StoreFiles(spark, str(tmp_path / "s"))
    for seconds, round_ in ((-1, 0), (600, 1)):  # the first round's claim has expired when the second begins
        holders = [RN.Claims(files, f"h{round_}-{i}", seconds) for i in range(8)]
        got, start = [], threading.Barrier(8)

        def take(h):
            start.wait()
            if h.take(("partition", "c/ %", "k=1")):
                got.append(h)
        threads = [threading.Thread(target=take, args=(h,)) for h in holders]
        [t.start() for t in threads]
        [t.join() for t in threads]
        if seconds > 0:
            assert len(got) == 1
    (winner,) = got
    assert not RN.Claims(files, "late", 600).take(("partition", "c/ %", "k=1"))
    winner.release()
    assert RN.Claims(files, "later", 1).take(("partition", "c/ %", "k=1"))


def test_a_run_that_lost_a_claim_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    store = ManifestStore(spark, root)
    rows = videos(read_frames_csv(spark, [exports(tmp_path)]))
    with store.begin(claim_seconds=-0.001) as slow:
        assert slow.claim([("Q7", "bow")]) == []
        slow.stage("videos", rows)
        with store.begin() as other:
            assert other.claim([("Q7", "bow")]) == []
            with pytest.raises(RN.ClaimLostError):
                slow.commit()
    assert stored(spark, root)[0] == {} and RN.recover(store.files) == {} and store.files.names("_staging") == []


def test_claims_are_renewed_while_a_run_lives(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path / "s"))
    with store.begin(claim_seconds=1.5) as run:
        run.claim([("Q7", "bow")])
        time.sleep(4)
        assert not RN.Claims(store.files, "other", 1).take(("partition", "Q7", "bow")) and RN.recover(store.files) == {}
    assert RN.Claims(store.files, "later", 1).take(("partition", "Q7", "bow"))


def test_an_ingest_beside_known_files_reads_no_stored_frame(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    ingest(spark, [export(tmp_path, "a.csv", frame_rows(clip("Q7", "bow", "a"), range(4)))], root, frames=True)
    store = ManifestStore(spark, root)
    assert store.unaccounted_frames(["Q7"]) is None
    from framefold.plans import ingest as module
    for name in ("leftover_frames",):
        monkeypatch.setattr(module, name, lambda *a: pytest.fail("stored frames were looked at"))
    monkeypatch.setattr(ManifestStore, "read_frames", lambda self: pytest.fail("stored frames were read"))
    s = ingest(spark, [export(tmp_path, "b.csv", frame_rows(clip("Q7", "keel", "b"), range(3)))], root, frames=True).summary.first()
    monkeypatch.undo()
    assert s.frames_written == 3 and stored(spark, root)[1] == {("Q7", "a"): 4, ("Q7", "b"): 3}
    store.append_frames(spark.createDataFrame([("c", 0, None, "ok", "Q7")], store.read_frames().schema))
    assert [r.video_id for r in store.unaccounted_frames(["Q7", "Z2"]).collect()] == ["c"] and store.unaccounted_frames(["Z2"]) is None


def test_partition_names_with_special_characters(spark, tmp_path):
    root = str(tmp_path / "s")
    path = export(tmp_path, "a.csv", frame_rows(clip("Q 7%", "bow=1:é", "v"), range(2)))
    with pytest.raises(Stop):
        ingest_rows(spark, read_frames_csv(spark, [path]), root, frames=True, on_move=stop_after(1))
    assert ingest(spark, [path], root, frames=True, skip_existing=True).summary.first().status == "nothing_new"
    assert stored(spark, root) == ({("Q 7%", "bow=1:é", "v"): 2}, {("Q 7%", "v"): 2})
    assert ManifestStore(spark, root).partition_folders() == {("Q 7%", "bow=1:é")}


def test_a_store_on_another_file_system(spark, tmp_path):
    (tmp_path / "mnt").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.other.link./data", f"file://{tmp_path}/mnt")
    path = exports(tmp_path / "mnt")
    root = "viewfs://other/data/store"
    with pytest.raises(Stop):
        ingest_rows(spark, read_frames_csv(spark, ["viewfs://other/data/*.csv"]), root, frames=True, on_move=stop_after(3))
    report = ingest(spark, ["viewfs://other/data/a*.csv"], root, exclude=["*/none.csv"], frames=True, skip_existing=True)
    assert list(report.recovered.values()) == ["published"] and stored(spark, root) == WHOLE
    assert path.endswith("all.csv")
    with pytest.raises(PartitionConflictError):
        ingest(spark, ["viewfs://other/data/all.csv"], root)
