"""WARC archives: writing with revisit records, an external index merge, reading back.

``write_archive`` writes gzip-per-record WARC files, a few per task, and returns the capture
index: one locally sorted run per file.  ``merge_index`` merges the runs into capture histories
ordered by URL key, timestamp and page id over all partitions: the runs are cut at common range
bounds and the slices of a range are merged by a k-way loser tree, which numbers the captures of
every URL and names the one before.  ``read_archive`` reads the records that an index names, file
piece by file piece, and checks their digests.

Tasks write to a file name of their own attempt, and only files named by the materialised index
are ever read, so that lost or repeated tasks leave no trace in the result.  Files go through
``pyarrow.fs`` to the cluster's shared folder.

Defined cases: null html is an empty payload, null url gives a record without target (its key
is empty and sorts first), null page_id gives a record whose page_id reads back as null and that
is never the target of a revisit nor one itself; rows that repeat a page_id are archived each, and
follow each other in a history in the order of their files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from looplake.llm.common import batch, cut_lineage, materialize, shared_folder

#: Records of at least this many payload bytes are archived once.
MIN_REVISIT_BYTES = 1000
#: Captures that a task merges, archive bytes of a piece that is read in order, tasks that read pieces.
RANGE_ROWS = 200_000
PIECE_BYTES = 8 << 20
MAX_READ_TASKS = 20_000
#: Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE, _NO_PAGE = 0x70616765 << 96, 0x6E6F6E65 << 96

INDEX = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()),
                   ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = "url_key string, captured string, page_id long, run string, offset long, length long"
MERGED = pa.schema([*INDEX, ("range", pa.int32()), ("pos", pa.int64()), ("place", pa.int64()), ("previous_page", pa.int64()),
                    ("from_start", pa.bool_())])
MERGED_DDL = f"{INDEX_DDL}, range int, pos long, place long, previous_page long, from_start boolean"
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORD_DDL = ("page_id long, url string, captured string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, payload binary")


def record_id(page_id: int | None) -> str:
    number = _NO_PAGE if page_id is None else _PAGE | (page_id & (1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(text: str) -> int | None:
    number = uuid.UUID(text.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 96 != _PAGE >> 96:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, in lower case; no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:  # not a URL: its own key
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def encode_record(page_id, url, captured, html, digest, holder) -> bytes:
    """One WARC record, a gzip member: a response, or a revisit of ``holder`` without the payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if holder is not None else http + payload
    head = [("WARC-Type", "response" if holder is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", captured), ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if holder is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(holder))]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> tuple:
    """The values of RECORD from one gzip member; raises if the payload does not fit its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not fit its digest")
    return (page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Date"], size, digest, kind,
            page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None)


def _with_roles(pages: DataFrame, captured: Column) -> DataFrame:
    """Pages with payload digest, capture time and, for revisits, the page they refer to."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                         captured.alias("captured"))
    seen = pages.where((F.octet_length("html") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()) \
        .select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"))
    holders = seen.groupBy("digest").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("first")) \
        .where("holder <> first").select("digest", "holder")
    revisits = seen.join(holders, "digest").where("page_id <> holder").groupBy("page_id", "digest") \
        .agg(F.max("holder").alias("holder"))
    return pages.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8")))) \
        .join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "captured", "html", "digest", "holder")


def default_capture(page_id: Column) -> Column:
    """Capture time of a table that has none: seconds after 2024 by page id, in WARC form."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(page_id.cast("long"), F.lit(0)), F.lit(10**9)))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archive(pages: DataFrame, folder: str | None = None, captured: Column | None = None,
                  roll_bytes: int = 1 << 30) -> DataFrame:
    """Write every page as a record; returns the capture index, a sorted run for each file."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    when = default_capture(F.col("page_id")) if captured is None else captured

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows = {n: [] for n in INDEX.names}
            columns = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                page_id, url, date, html, digest, holder = (c[i].as_py() for c in columns)
                if out is None:
                    store.create_dir(root, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = encode_record(page_id, url, date, html, digest.hex(), holder)
                out.write(member)
                for n, v in zip(INDEX.names, (url_key(url), date, page_id, name, at, len(member)), strict=True):
                    rows[n].append(v)
                at += len(member)
                if at >= roll_bytes:
                    out.close()
                    out = None
            yield batch(INDEX, rows)
        if out is not None:
            out.close()

    index = _with_roles(pages, when).mapInArrow(run, INDEX_DDL) \
        .sortWithinPartitions("run", "url_key", "captured", "page_id", "offset")
    return materialize(index).withColumn("folder", F.lit(folder))


class LoserTree:
    """k-way merge of sorted lists: the tree keeps the loser of every match, so that the next
    smallest item costs one match on each level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        """Does the head of run a come before that of run b? -1 is a run that has not entered."""
        if a < 0 or b < 0:
            return a < 0
        if self.at[a] >= len(self.runs[a]) or self.at[b] >= len(self.runs[b]):
            return self.at[b] >= len(self.runs[b]) and self.at[a] < len(self.runs[a])
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _replay(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self._before(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.at[w := self.tree[0]] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._replay(w)


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Capture histories: all runs merged, globally ordered by URL key, time and page id, each capture with
    ``capture_no``, its place in the history of its URL key from 1, and ``previous_page``, the page of the
    capture before it (null for the first).

    The range bounds include the page id and the place in the archive, so that a URL with very many captures
    is cut too; a task merges about ``range_rows`` captures, however long the index is.  The histories of
    URLs that go on in the next range are carried over by a table of one row a range."""
    ranges = max(1, -(-index.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a range of the index: small rows, a bounded number of them; each run's slice is sorted
        runs: dict[str, list] = {}
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in INDEX.names), strict=True):
                key = (row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4])
                runs.setdefault(row[3], []).append((key, row))
        number = TaskContext.get().partitionId()
        out, pos, place, url, first, page = [], 0, 0, None, True, None
        for _, row in LoserTree(list(runs.values())):
            if row[0] != url:
                first, place, page = url is None, 0, None
            url, pos, place = row[0], pos + 1, place + 1
            out.append((*row, number, pos, place, page, first))
            page = row[2]
            if len(out) >= 10_000:
                yield batch(MERGED, dict(zip(MERGED.names, zip(*out), strict=True)))
                out = []
        if out:
            yield batch(MERGED, dict(zip(MERGED.names, zip(*out), strict=True)))

    order = ["url_key", "captured", "page_id"]
    merged = cut_lineage(index.repartitionByRange(ranges, *order, "run", "offset").sortWithinPartitions("run", *order, "offset")
                         .select(*INDEX.names).mapInArrow(merge, MERGED_DDL))
    ends = merged.groupBy("range").agg(
        F.min_by("url_key", "pos").alias("first"), F.count_if("from_start").alias("n_first"), F.max_by("url_key", "pos").alias("last"),
        F.max_by("place", "pos").alias("n_last"), F.max_by("page_id", "pos").alias("page"))
    # a range's first and last URL; between them no URL reaches into another range
    entries = ends.select("range", F.col("first").alias("url_key"), F.col("n_first").alias("n"), "page", F.lit(True).alias("starts")) \
        .unionByName(ends.where("first <> last").select("range", F.col("last").alias("url_key"), F.col("n_last").alias("n"), "page",
                                                        F.lit(False).alias("starts")))
    before = Window.partitionBy("url_key").orderBy("range")
    carried = entries.withColumn("carried", F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("carried_page", F.lag("page").over(before)).where("starts and carried is not null") \
        .select("range", "carried", "carried_page")
    # one row of three numbers for range_rows captures at most
    goes_on = F.col("from_start") & F.col("carried").isNotNull()
    return merged.join(F.broadcast(carried), "range", "left").select(
        *INDEX.names, (F.col("place") + F.when(goes_on, F.col("carried")).otherwise(0)).alias("capture_no"),
        F.when(goes_on & (F.col("place") == 1), F.col("carried_page")).otherwise(F.col("previous_page")).alias("previous_page"))


def read_archive(index: DataFrame, folder: str, *keep: str, payload: bool = False, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The records that an index names, with the index's columns ``keep``; payloads are checked, and returned
    if asked for.  Tasks are cut by archive bytes: pieces of a file, whatever the index weighs."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(MAX_READ_TASKS, max(1, -(-total // piece_bytes)))
    kept = index.select(*keep).schema if keep else StructType()
    result = StructType.fromDDL(RECORD_DDL)
    schema = to_arrow_schema(StructType(result.fields + kept.fields))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for b in batches:
            rows: list = []
            for run, offset, length, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run != name:
                    name, file = run, store.open_input_file(f"{root}/{run}")
                file.seek(offset)
                row = decode_record(file.read(length))
                rows.append((*(row if payload else (*row[:-1], None)), *more))
                if payload and len(rows) >= 512:
                    yield batch(schema, dict(zip(schema.names, zip(*rows), strict=True)))
                    rows = []
            if rows:
                yield batch(schema, dict(zip(schema.names, zip(*rows), strict=True)))

    return index.select("run", "offset", "length", *keep).repartition(tasks, "run", F.expr(f"offset div {piece_bytes}")) \
        .sortWithinPartitions("run", "offset").mapInArrow(read, StructType(result.fields + kept.fields))
