"""WARC archives with an external-merge capture index.

Records are written by the tasks that hold the pages, locally sorted by (URL key, time): each task writes one archive (a
gzip member a record) and, in the same order, one run of the index as a file of compressed blocks. Only a line a block
(where it lies, its first and last key) travels. An external merge makes the capture history: ranges of keys are cut from
a bounded sample of the blocks' first keys; each range streams the blocks of every run that reach into it through a loser
tree. More than FAN_IN runs are merged group by group into longer runs first. Keys end in (run, place), so they are
distinct: a range can begin anywhere among the captures of one URL. The last merge walks the captures in global order and
reads each record at its offset; the rows returned come from that walk. As runs and archives have one order, the walk goes
forward through each archive, a piece of READ_AHEAD bytes at a time.
Of equal payloads of at least min_bytes the one with the smallest page_id is the response; the others are revisits that
refer to it. Pages have no time of capture: page n is captured n seconds after EPOCH (modulo SPAN seconds).

Defined cases: null html is an empty payload; a null url has an empty URL key; null page_ids are captured at EPOCH, written
as responses of their own and never referred to; rows repeated under one id are equal payloads under that id, hence
responses each; an empty table gives no archives and no rows; long payloads are one record each; extra columns are not
read; ids are whole at any size.
"""

import hashlib
import json
import re
import zlib

from bisect import bisect_right
from collections import OrderedDict
from datetime import datetime, timedelta, timezone
from itertools import groupby
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from stepforge.llm.storage import bounded_batches, bounded_broadcast, hash_sample, map_frames, materialize, new_path, whole

MIN_BYTES = 100
EPOCH, SPAN = datetime(2020, 1, 1, tzinfo=timezone.utc), 10**9
#: Entries of a block of a run and of a range of the merge; most ranges; most runs that one merge reads.
BLOCK_ROWS, RANGE_ROWS, MOST_RANGES, FAN_IN = 128, 2_000, 4096, 128
#: Bytes read ahead of an archive, and archives kept open at once.
READ_AHEAD, MOST_OPEN = 1 << 16, 256
_VERSION = b"WARC/1.1\r\n"


# ---- files in the shared folder -------------------------------------------------------------------------------------

def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


# ---- records ---------------------------------------------------------------------------------------------------------

def record(page_id, url: str, date: str, payload: bytes, kind: str, digest: str, refers_to) -> bytes:
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"),
    ]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + payload + b"\r\n\r\n"


def read_records(data: bytes):
    """(headers, payload) of each record; lengths, not separators, tell where a record ends."""
    at = 0
    while at < len(data):
        if not data.startswith(_VERSION, at):
            raise ValueError(f"not a record: {data[at:at + 40]!r}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at + len(_VERSION) : end].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(line.partition(": ")[::2] for line in lines)
        at = end + 4 + int(head["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield head, data[end + 4 : at]
        at += 4


def url_key(url: str) -> str:
    """Host parts reversed, then path and query: captures of a host and of its subdomains lie together."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url or ""
    return f"{','.join(reversed(host.split('.')))}){u.path or '/'}" + (f"?{u.query}" if u.query else "") if host else ""


# ---- loser tree ------------------------------------------------------------------------------------------------------

class LoserTree:
    """Merges k sorted iterators: each inner node keeps the loser of its match, the overall winner is replayed upwards."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _next(self, i):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, i, j) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or a[:2] < b[:2])

    def _replay(self, i) -> None:
        node = (i + self.k) // 2
        while node:
            j = self.losers[node]
            if j == -1:  # the first to come waits here for its opponent
                self.losers[node] = i
                return
            if self._beats(j, i):
                self.losers[node], i = i, j
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w][2]
            self.heads[w] = self._next(w)
            self._replay(w)


# ---- operator --------------------------------------------------------------------------------------------------------

def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, record_type, refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    long_ = rows.where((F.octet_length(html) >= min_bytes) & F.col("page_id").isNotNull())
    first = long_.groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.max("page_id").alias("__last")).where("__first < __last").drop("__last")
    first = materialize(first, "shared-payloads")
    both = rows.join(bounded_broadcast(first, first.count()), "payload_digest", "left")
    again = F.coalesce((F.col("__first") < F.col("page_id")), F.lit(False)) & (F.octet_length(html) >= min_bytes)
    return both.select("page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"))


def capture_time(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % SPAN)).isoformat()[:19] + "Z"


@F.pandas_udf(StringType())
def _url_keys(url: pd.Series) -> pd.Series:
    return url.map(lambda u: url_key(u if isinstance(u, str) else ""))


def entry_key(e: list) -> tuple:
    """Of an entry [urlkey, time, page_id, run, place, record_type, file, offset, length]; keys are distinct."""
    return e[0], e[1], e[2] is not None, e[2] or 0, e[3], e[4]


class _RunWriter:
    """A run of entries as a file of compressed blocks; blocks() are its lines of the table of blocks."""

    def __init__(self, run: int, name: str):
        self.run, self.name, self.at, self.entries, self.rows = run, name, 0, [], []
        fs, p = _filesystem(name)
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(p, compression=None)

    def add(self, entry: list) -> None:
        self.entries.append(entry)
        if len(self.entries) == BLOCK_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.entries:
            data = zlib.compress(json.dumps(self.entries).encode(), 1)
            self.out.write(data)
            ends = [json.dumps(entry_key(self.entries[k])) for k in (0, -1)]
            self.rows.append((self.run, self.name, self.at, len(data), len(self.entries), *ends))
            self.at += len(data)
            self.entries = []

    def blocks(self) -> pd.DataFrame:
        self.flush()
        self.out.close()
        return pd.DataFrame(self.rows, columns=["run", "path", "at", "bytes", "n", "first", "last"])


_BLOCKS = "run long, path string, at long, bytes long, n long, first string, last string"


def _own_name(folder: str, kind: str) -> str:
    """Another attempt of a task writes other files; only the one that counts gives its names on."""
    ctx = TaskContext.get()
    return f"{folder}/{kind}-{ctx.partitionId():06d}-{ctx.attemptNumber()}-{ctx.taskAttemptId()}"


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and their runs; returns the table of the runs' blocks."""
    placed = planned.withColumn("__key", _url_keys("url"))
    # local order only: no record leaves its task
    placed = bounded_batches(placed).sortWithinPartitions("__key", F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN)), "page_id")

    def write(frames):
        run, archive, index, at, place = TaskContext.get().partitionId(), None, None, 0, 0
        for pdf in frames:
            cols = [pdf[c].tolist() for c in ("url", "__key", "html", "record_type", "payload_digest")]
            for page, ref, url, urlkey, html, kind, digest in zip(whole(pdf["page_id"]), whole(pdf["refers_to"]), *cols, strict=True):
                if archive is None:
                    name = _own_name(folder, "part") + ".warc.gz"
                    index = _RunWriter(run, name.replace(".warc.gz", ".idx"))
                    fs, p = _filesystem(name)
                    archive = fs.open_output_stream(p, compression=None)
                payload = (html if isinstance(html, str) else "").encode("utf-8", "surrogatepass")
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                time = capture_time(page)
                data = z.compress(record(page, url if isinstance(url, str) else "", time, payload, kind, digest, ref)) + z.flush()
                archive.write(data)
                index.add([urlkey, time, page, run, place, kind, name, at, len(data)])
                at += len(data)
                place += 1
        if archive is not None:
            archive.close()
            yield index.blocks()

    return map_frames(placed, write, _BLOCKS)


def _cuts(blocks: DataFrame, ranges: int) -> list[tuple]:
    """At most `ranges` - 1 keys at which ranges begin, from a bounded sample of the blocks' first keys."""
    keys = sorted(tuple(json.loads(r["first"])) for r in hash_sample(blocks, "first", 16 * ranges, ["first"]))
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def _entries(blocks, lo, hi):
    """The entries of one run's blocks (path, at, bytes) from key lo on and before key hi."""
    for path, at, size in blocks:
        fs, p = _filesystem(path)
        with fs.open_input_file(p) as f:
            f.seek(at)
            found = json.loads(zlib.decompress(f.read(size)))
        for e in found:
            k = entry_key(e)
            if (lo is None or k >= lo) and (hi is None or k < hi):
                yield e


def _merged(blocks: DataFrame, cuts: list[tuple], group_of, use, schema: str) -> DataFrame:
    """use(entries in order, group, range) for every range of each group of runs; it yields frames."""

    def reach(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                lo, hi = (bisect_right(cuts, tuple(json.loads(k))) for k in (r.first, r.last))
                out += [(group_of(int(r.run)), k, *r) for k in range(lo, hi + 1)]
            yield pd.DataFrame(out, columns=["group", "range", *pdf.columns])

    spread = map_frames(blocks, reach, f"group long, range int, {_BLOCKS}")
    # a number of its own: the table is small in bytes, but each line stands for a block to read
    parts = max(1, min(MOST_RANGES, 2 * (len(cuts) + 1)))
    dealt = spread.repartition(parts, "group", "range").sortWithinPartitions("group", "range", "run", "path", "at")

    def merge(frames):
        rows = (r for pdf in frames for r in zip(*(pdf[c].tolist() for c in ("group", "range", "run", "path", "at", "bytes")), strict=True))
        for (group, k), own in groupby(rows, lambda r: r[:2]):
            runs = [[r[3:] for r in of] for _, of in groupby(own, lambda r: r[2])]  # where a range's blocks lie, a line each
            lo, hi = cuts[k - 1] if k else None, cuts[k] if k < len(cuts) else None
            yield from use(iter(LoserTree([_entries(sorted(r, key=lambda b: (b[0], b[1])), lo, hi) for r in runs], entry_key)), group, k)

    return map_frames(dealt, merge, schema)


def merge_runs(blocks: DataFrame, folder: str, cuts: list[tuple], fan_in: int = FAN_IN) -> DataFrame:
    """Blocks of at most fan_in runs: groups of that many are merged into one, pass after pass."""
    passed = 0
    while True:
        runs = blocks.agg(F.max("run")).first()[0]
        if runs is None or runs < fan_in:
            return blocks
        passed += 1

        def rewrite(entries, group, k, passed=passed):
            # files of a run are named in the order of its ranges
            out = _RunWriter(group, f"{folder}/pass-{passed}-{group:08d}/{k:06d}-{TaskContext.get().taskAttemptId()}.idx")
            for e in entries:
                out.add(e)
            yield out.blocks()

        blocks = materialize(_merged(blocks, cuts, lambda run: run // fan_in, rewrite, _BLOCKS), "blocks")


class Archives:
    """Records at offsets of archives: a piece of READ_AHEAD bytes of each of the last MOST_OPEN archives stays."""

    def __init__(self):
        self.pieces: OrderedDict[str, tuple[int, bytes]] = OrderedDict()

    def read(self, name: str, offset: int, length: int):
        """(headers, payload) of the record there."""
        start, data = self.pieces.get(name, (0, b""))
        if not start <= offset <= offset + length <= start + len(data):
            fs, p = _filesystem(name)
            with fs.open_input_file(p) as f:
                f.seek(offset)
                start, data = offset, f.read(max(length, READ_AHEAD))
            self.pieces[name] = (start, data)
            if len(self.pieces) > MOST_OPEN:
                self.pieces.popitem(last=False)
        self.pieces.move_to_end(name)
        member = data[offset - start : offset - start + length]
        if len(member) < length:
            raise ValueError(f"{name} ends within a record")
        found = list(read_records(zlib.decompress(member, 31)))
        if len(found) != 1:
            raise ValueError(f"{name} at {offset}: {len(found)} records")
        return found[0]


_HISTORY = "part int, rank long, urlkey string, ts string, run long, file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(uri: str) -> int | None:
    return int(uri[10:-1]) if uri[10:-1] else None


def walk(entries, part: int, frame_rows: int = 2000):
    """Frames of _HISTORY: each capture in order, read where its entry says."""
    archives, out = Archives(), []
    for rank, e in enumerate(entries):
        head, payload = archives.read(*e[6:9])
        full = head["WARC-Type"] == "response"
        digest = hashlib.sha256(payload).hexdigest() if full else head["WARC-Payload-Digest"][7:]
        if full and f"sha256:{digest}" != head["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        page = _page(head["WARC-Record-ID"])
        if (page, head["WARC-Date"], head["WARC-Type"]) != (e[2], e[1], e[5]):
            raise ValueError(f"{e[6]} at {e[7]}: not the record of the index")
        ref = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
        out.append((part, rank, e[0], e[1], e[3], *e[6:9], page, head["WARC-Target-URI"], len(payload) if full else int(head["X-Payload-Length"]), digest, head["WARC-Type"], ref))
        if len(out) == frame_rows:
            yield _history(out)
            out = []
    if out:
        yield _history(out)


def _history(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[f.split()[0] for f in _HISTORY.split(", ")], dtype=object)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_history(blocks: DataFrame, folder: str, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Every capture in global (urlkey, ts, page_id) order: range part, then rank in it, the entry, and what was read there."""
    n = blocks.agg(F.sum("n")).first()[0] or 0
    cuts = _cuts(blocks, min(MOST_RANGES, max(1, -(-n // range_rows))))
    blocks = merge_runs(blocks, folder, cuts, fan_in)
    return _merged(blocks, cuts, lambda run: 0, lambda entries, group, k: walk(entries, k), _HISTORY)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Writes pages as archives into folder (default: the shared folder); returns the capture history read back from them."""
    folder = folder or new_path(pages.sparkSession, "warc")
    blocks = materialize(write_archives(plan_records(pages, min_bytes), folder), "index-blocks")
    return read_history(blocks, folder, range_rows, fan_in)
