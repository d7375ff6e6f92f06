"""WARC round trip, revisit rules, and the splittable reader at every split size."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import pyarrow as pa
import pyarrow.fs
import pytest

from geodemand.llm import warc as W
from geodemand.llm.warc import MAGIC, parse, read_warc, record, record_starts, write_warc


def _sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}?a=b c\n", "".join(rng.choice("abc<>é\n") for _ in range(rng.randrange(3000)))) for i in range(80)]
    rows += [(100 + i, None, rows[5][2]) for i in range(40)] + [(200, "u", ""), (201, "u", None), (202, "u", "")]
    rows += [(None, "u", "lonely"), (None, "u", rows[5][2]), (300, "u", "twice"), (300, "u", "twice")]
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, payload string"), rows


def test_round_trip_and_revisits(spark, tmp_path):
    pages, rows = _pages(spark)
    folder = f"file://{tmp_path}/w"
    assert write_warc(pages, folder, salts=3) == len(rows)
    best = {}
    for i, _, h in rows:
        best.setdefault(h or "", []).append(-1 if i is None else i)
    want = []
    for i, _, h in rows:
        top = max(best[h or ""])
        first = (-1 if i is None else i) == top
        want.append((i, len((h or "").encode()), _sha((h or "").encode()), "response" if first else "revisit", None if first else top))
    for split in (1 << 22, 3000):
        got = [(None if r.key is None else int(r.key), r.payload_bytes, r.payload_digest, r.record_type,
                None if r.refers_to is None else int(r.refers_to)) for r in read_warc(spark, folder, split=split).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    payloads = {int(r.key): bytes(r.payload).decode() for r in read_warc(spark, folder).where("record_type = 'response'").collect() if r.key}
    assert all(payloads[i] == h for i, _, h in rows[:80] if i in payloads and rows.count((i, _, h)) == 1)


def test_archives_are_plain_concatenated_gzip(spark, tmp_path):
    pages, rows = _pages(spark)
    write_warc(pages.coalesce(1), f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    assert not list((tmp_path / "w").glob("_attempt*"))


@pytest.mark.parametrize("refuses", [False, True])
def test_a_task_that_runs_again_adds_nothing(tmp_path, monkeypatch, refuses):
    """Also where a move onto a name that exists is refused and where the other attempt ends in between."""
    attempt = [0]

    class Context:
        partitionId = staticmethod(lambda: 3)
        taskAttemptId = staticmethod(lambda: attempt[0])

    class Refusing:
        def __init__(self, system):
            self.system, self.asked = system, 0

        def __getattr__(self, name):
            return getattr(self.system, name)

        def get_file_info(self, path):
            self.asked += 1
            return self.system.get_file_info(path if self.asked > 1 else path + "-not-yet")

        def move(self, a, b):
            if self.system.get_file_info(b).type != pa.fs.FileType.NotFound:
                raise OSError("exists")
            self.system.move(a, b)

    plain = W.open_folder
    monkeypatch.setattr(W, "TaskContext", type("T", (), {"get": staticmethod(Context)}))
    if refuses:
        monkeypatch.setattr(W, "open_folder", lambda uri: (Refusing(plain(uri)[0]), plain(uri)[1]))
    batch = pa.RecordBatch.from_pylist([{"key": str(i), "uri": "u", "payload": "x" * i, "digest": hashlib.sha1(b"x" * i).hexdigest(), "first": None}
                                        for i in range(5)])
    counts = []
    for attempt[0] in range(3):
        counts += [n for b in W._write(iter([batch]), f"{tmp_path}/w", "2024-01-01T00:00:00Z", 6, "r") for n in b["records"].to_pylist()]
    assert counts == [5, 5, 5]
    assert [p.name for p in (tmp_path / "w").iterdir()] == ["part-r-000003.warc.gz"]


def test_ids_with_signs_and_ranges_in_one_task(spark, tmp_path):
    ids = ["<a>", "b\r\nX: y", "50%25 é", "plain"]
    pages = spark.createDataFrame([(i, "http://x/", "same" if k < 2 else f"own{k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    folder = f"{tmp_path}/w"
    assert write_warc(pages, folder) == 4
    few = read_warc(spark, folder, split=64, ranges_per_task=1000)
    got = {r.key: (r.record_type, r.refers_to) for r in few.collect()}
    assert got == {"<a>": ("revisit", "b\r\nX: y"), **{i: ("response", None) for i in ids[1:]}}
    with pytest.raises(FileExistsError):
        write_warc(pages, folder)


def test_empty_table_writes_nothing(spark, tmp_path):
    assert write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w") == 0


def _archive(payloads, stored=False):
    out, starts = b"", []
    for k, p in enumerate(payloads):
        starts.append(len(out))
        deflate = zlib.compressobj(0 if stored else 6, zlib.DEFLATED, 31)
        out += deflate.compress(record("response", str(k), "u", p, _sha(p), "d", offset=len(out))) + deflate.flush()
    return out, starts


def test_every_split_owns_each_record_once():
    rng = random.Random(1)
    inner, _ = _archive([b"inside", b"also inside"])
    payloads = [rng.randbytes(rng.randrange(400)) for _ in range(30)] + [MAGIC * 40, inner, b"x" + inner[:90], MAGIC + inner]
    data, starts = _archive(payloads, stored=True)  # stored blocks: the magic bytes and whole members show in the archive
    for split in (1, 7, 64, 501, len(data)):
        got = [s for b in range(0, len(data), split) for s in record_starts(io.BytesIO(data), len(data), b, b + split)]
        assert got == starts
    joined = data + data  # stated offsets no longer hold: settled from the start
    got = [s for b in range(0, len(joined), 5000) for s in record_starts(io.BytesIO(joined), len(joined), b, b + 5000)]
    assert got == starts + [s + len(data) for s in starts]
    fields, payload = parse(gzip.decompress(data[starts[3]:starts[4]]))
    assert payload == payloads[3] and fields["warc-type"] == "response"


def test_damage_is_an_error():
    data, starts = _archive([b"a" * 500, b"b" * 500, b"c" * 500])
    with pytest.raises(ValueError):
        record_starts(io.BytesIO(data[:-5]), len(data) - 5, 0, len(data))
    broken = bytearray(data)
    broken[starts[1] + 40] ^= 255
    with pytest.raises(ValueError):
        record_starts(io.BytesIO(bytes(broken)), len(data), 0, len(data))
