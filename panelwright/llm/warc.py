"""WARC archives of pages, and their index by external merge.

``write_archives`` writes one record a page to gzip archives in a folder that all executors
share; payloads that are already held by another record become ``revisit`` records without
payload. ``read_archives`` parses archives record by record. ``merged_index`` brings their
captures into one global order, by URL key, time and id: each task sorts what it has read into
one run, splitters from a bounded sample cut the key space into ranges, and a loser tree merges
the runs of a range, at most ``FAN_IN`` at a time: more runs take more passes, each of which
makes runs ``FAN_IN`` times as long over ranges as much narrower.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, join_on_hot_key, read, schema_of, shared_dir

#: Archives hold as many records as ``ARCHIVE_BYTES`` have room for, by size class of the payloads (a class ends at these bytes).
ARCHIVE_BYTES, ARCHIVE_RECORDS, CLASSES = 64 << 20, 2000, (1 << 15, 1 << 18, 1 << 21)
#: Captures of a merge range, about; sampled keys a range; runs that are merged at once.
RANGE_CAPTURES, SAMPLE_KEYS, FAN_IN = 200_000, 16, 64
#: Pages have no time: captures are dated by their id, within 68 years of 2020, so that times of any ids have one width.
FIRST_SECOND, SECONDS = 1_577_836_800, 1 << 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: F.Column) -> F.Column:
    """SHA-1 of a binary column in base 32: every five hex digits make four characters."""
    digest = F.sha1(payload)
    parts = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def capture_records(pages: DataFrame) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) with its payload's digest and the page that holds the payload.

    Returns ``page_id``, ``url``, ``html``, ``digest`` and ``refers_to``; other columns have no
    place in an archive and are left out. Of pages with equal payloads the one with the largest id
    is the response (``refers_to`` is null); the others refer to it. Payloads are equal if their
    SHA-1, length and 64-bit hash are. Null html is an empty payload, and empty payloads are
    equal. Null ids and urls are written as empty values. Runs jobs when called.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    same = F.concat_ws(":", "digest", F.octet_length("html"), F.xxhash64(payload))
    rows = rows.withColumn("digest", base32_sha1(payload)).withColumn("same", same)
    # who holds what is settled without the payloads; only rows whose payload recurs look it up, and no common payload is one task's
    shared = cut(rows.groupBy("same").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    recurring = join_on_hot_key(rows.select("page_id", "same"), shared, "same", "n", total)
    other = recurring.where(~F.col("page_id").eqNullSafe(F.col("holder"))).select(F.col("page_id").alias("_page"), F.col("same").alias("_same"), F.col("holder").alias("refers_to"))
    # payloads meet their holder by page and payload, which no common payload makes hot
    own = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("same") == F.col("_same"))
    return rows.join(cut(other.distinct()), own, "left").drop("_page", "_same", "same")


def write_archives(records: DataFrame, folder: str) -> str:
    """Write ``capture_records`` rows as gzip WARC files below ``folder`` and return their path.

    Records are written by size class of their payloads, so that an archive holds about
    ``ARCHIVE_BYTES`` of plain text at most, or one record that is longer. Each archive is gzipped
    whole, as Spark's writer does.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    second = F.lit(FIRST_SECOND) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(SECONDS))
    when = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.octet_length("html"), F.lit(line * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(f">{line}WARC-Date: "), when,
        F.lit(f"{line}WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "%0A"),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Profile: {PROFILE}{line}WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), F.octet_length(block), F.lit(line * 2),
    )
    path = f"{folder.rstrip('/')}/{fresh('warc')}"
    size = F.octet_length("html")
    for low, high in zip((0, *CLASSES), (*CLASSES, None), strict=True):
        # asked of the payload, the class is told before any join that ``records`` stands for
        own = records.where(size >= low) if high is None else records.where((size >= low) & (size < high))
        most = 1 if high is None else min(ARCHIVE_RECORDS, ARCHIVE_BYTES // high)
        # a record ends with two line ends, which the writer adds
        writer = own.select(F.concat(head, block).alias("value")).write.mode("append")
        writer.option("lineSep", line * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    return path


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, a bracket, path and query; lower case, without www and fragment."""
    m = re.match(r"[a-z]+://(?:www\.)?([^/?]*)(.*)$", re.sub(r"#.*$", "", url.lower(), flags=re.S), re.S)
    return ",".join(reversed(m[1].split("."))) + ")" + m[2] if m else url.lower()


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, with the offset of each in the plain file."""
    data, at = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at offset {at}")
        head = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        start, size = end + 4, int(head["content-length"])
        block = data[start : start + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head | {"offset": at, "http": http, "payload": payload}
        at = start + size + 4


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_time string, archive string, offset long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below ``path``, sorted by URL key, time and id within each archive.

    The payload of a response is hashed anew; a digest that differs from the record's raises.
    A revisit's length and digest are those of the payload that it refers to.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")

    def number(ref: str) -> int | None:
        found = re.search(r"<urn:page:(-?\d+)>", ref)
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in parse_archive(content.as_py()):
                    digest, kind = r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"]
                    if kind == "response":
                        own = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                        if own != digest:
                            raise ValueError(f"digest of the record at {r['offset']} of {name} differs")
                        size = len(r["payload"])
                    else:
                        size = int(re.search(rb"(?i)content-length: *(\d+)", r["http"])[1])
                    rows.append((number(r["warc-record-id"]), size, digest, kind, number(r.get("warc-refers-to", "")), url_key(r["warc-target-uri"]), r["warc-date"], name, r["offset"]))
                rows.sort(key=_order)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    return files.mapInArrow(run, CAPTURE)


_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_TYPES = [pa.int64() if x.split()[1] == "long" else pa.string() for x in CAPTURE.split(", ")]


def _order(row: tuple) -> tuple:
    """Sort key of a capture: URL key, time, id; null ids first."""
    return row[5], row[6], -(1 << 63) if row[0] is None else row[0], row[7], row[8]


class LoserTree:
    """Merge of k sorted key lists: each inner node holds the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (b, a) if self._less(b, a) else (a, b)
        self.tree[0] = winners[1] if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in merged order."""
        while self.k and self.at[won := self.tree[0]] < len(self.runs[won]):
            yield won, self.at[won]
            self.at[won] += 1
            node = (won + self.k) // 2
            while node:
                if self._less(self.tree[node], won):
                    self.tree[node], won = won, self.tree[node]
                node //= 2
            self.tree[0] = won


def _merge_runs(rows: DataFrame, tag: list[str]) -> DataFrame:
    """Rows dealt by ``tag`` (range, next run) and sorted by run and key in their partition: each tag's runs merged by a loser tree."""
    names = rows.columns
    at = [names.index(c) for c in tag]
    run_at, fields = names.index("_run"), [names.index(c) for c in _NAMES]

    def merged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        run = whole.column(run_at).to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]))
        keys = list(map(_order, zip(*(whole.column(i).to_pylist() for i in fields), strict=True)))
        runs = [keys[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        order = np.fromiter((edge[k] + i for k, i in LoserTree(runs)), dtype=np.int64, count=len(keys))
        yield from whole.take(pa.array(order)).append_column("_place", pa.array(np.arange(len(order)))).combine_chunks().to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in at)
            edges = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if x == y:
                    continue
                if held and tuple(held[-1].column(i)[0].as_py() for i in at) != (a[x], b[x]):
                    yield from merged(held)
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield from merged(held)

    return rows.mapInArrow(run, schema_of(rows, "_place long"))


def merged_index(captures: DataFrame) -> DataFrame:
    """``read_archives`` rows with ``capture_no``, their place (from 0) in the global order of URL key, time and id.

    Equal keys keep the order of their archives and offsets. One host, or one URL, may hold most
    captures: ranges are cut by time and id as well, so a range has about ``RANGE_CAPTURES`` rows,
    if it isn't one repeated key. What reaches the driver is ``SAMPLE_KEYS`` keys and one count a
    range. Runs jobs when called.
    """
    key = ["url_key", "capture_time", "page_id", "archive", "offset"]
    # a task's captures are one run, sorted where they were read
    runs = cut(captures.select(*_NAMES).withColumn("_run", F.spark_partition_id()).sortWithinPartitions(*key))
    n, n_runs = runs.agg(F.count(F.lit(1)), F.max("_run")).first()
    parts = max(1, -(-n // RANGE_CAPTURES))
    rate = min(1.0, parts * SAMPLE_KEYS / max(n, 1))
    sample = runs.where(F.pmod(F.xxhash64("page_id", "archive", "offset"), F.lit(1 << 30)) < int(rate * (1 << 30))).select(*key[:3]).collect() if parts > 1 else []
    keys = sorted((r["url_key"], r["capture_time"], -(1 << 63) if r["page_id"] is None else r["page_id"]) for r in sample)
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            url, when, page = (batch.column(c).to_pylist() for c in key[:3])
            own = [bisect_right(cuts, (u, t, -(1 << 63) if p is None else p)) for u, t, p in zip(url, when, page, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, type=pa.int32())], names=[*batch.schema.names, "_part"])

    rows = cut(runs.mapInArrow(ranged, schema_of(runs, "_part int")))
    sizes = dict(rows.groupBy("_part").count().collect())
    starts = np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(len(cuts) + 1)])))
    passes, left = 1, -(-((n_runs or 0) + 1) // FAN_IN)
    while left > 1:
        passes, left = passes + 1, -(-left // FAN_IN)
    for k in range(1, passes + 1):
        ranges = max(1, round((len(cuts) + 1) ** (k / passes)))
        wide = rows.withColumn("_range", F.floor(F.col("_part").cast("long") * ranges / (len(cuts) + 1)).cast("int")).withColumn("_next", F.floor(F.col("_run") / FAN_IN).cast("int"))
        groups = max(1, ranges * -(-((n_runs or 0) + 1) // FAN_IN**k))
        wide = wide.repartition(groups, "_range", "_next").sortWithinPartitions("_range", "_next", "_run", *key)
        rows = _merge_runs(wide, ["_range", "_next"])
        if k < passes:
            rows = cut(rows.drop("_range", "_run", "_place").withColumnRenamed("_next", "_run"))
    begin = F.broadcast(captures.sparkSession.createDataFrame(list(enumerate(starts[:-1].tolist())), "_part int, _start long"))
    return rows.join(begin, "_part").select(*_NAMES, (F.col("_start") + F.col("_place")).alias("capture_no"))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and put the captures in order."""
    path = write_archives(capture_records(read(spark, sf_dir, "pages")), shared_dir(spark))
    index = merged_index(cut(read_archives(spark, path)))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT *, regexp_replace(lower(url), '#.*$', '', 's') AS u,
    max(page_id) OVER (PARTITION BY html) AS holder,
    list_transform(range(8), lambda i: ('0x' || substr(hex, 1 + 5 * i::INT, 5))::BIGINT) AS words FROM p
), x AS (
  SELECT *, regexp_extract(u, '^[a-z]+://(?:www\\.)?([^/?]*)', 1) AS host, regexp_extract(u, '^[a-z]+://[^/?]*(.*)$', 1, 's') AS path FROM k
), y AS (
  SELECT *, CASE WHEN regexp_matches(u, '^[a-z]+://') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path ELSE lower(url) END AS url_key FROM x
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(words, lambda w: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to,
  url_key, row_number() OVER (ORDER BY url_key, ((page_id % 2147483648) + 2147483648) % 2147483648, page_id) - 1 AS capture_no
FROM y
"""
