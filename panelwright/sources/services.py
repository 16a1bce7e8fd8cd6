"""Paged services as Python data sources: one partition a query, pages read where the partition runs.

``PagedSource`` takes a transport, so that tests and offline runs can answer from memory; the
default reads over HTTP with back-off, and says so clearly when there is no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def get_json(url: str, tries: int = 4, fetch: Callable[[str], tuple[int, bytes]] | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """JSON of a URL. Network errors wait 3 * 2^k seconds, 429 and 5xx 2^k; 404 is empty; other codes raise."""
    for k in range(tries):
        try:
            status, body = (fetch or _http)(url)
        except OSError as e:
            if k == tries - 1:
                raise RuntimeError(f"no answer from {url}: {e}") from e
            sleep(3 * 2**k)
            continue
        if status == 404:
            return {}
        if status == 200:
            return json.loads(body)
        if status != 429 and status < 500:
            raise RuntimeError(f"status {status} from {url}")
        sleep(2**k)
    raise RuntimeError(f"no answer from {url}")


def _http(url: str) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=30) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def list_pages(url: str, params: dict[str, str], get: Callable[[str], dict] = get_json) -> Iterator[dict]:
    """Rows of a list whose pages are numbered and say how many there are."""
    page, pages = 1, 1
    while page <= pages:
        js = get(f"{url}?{urllib.parse.urlencode(params | {'page': str(page)})}")
        data = js.get("data")
        if js.get("data-availability", "available") != "available" or not isinstance(data, list) or len(data) < 2:
            return
        pages = int(data[0].get("pages", 1))
        yield from data[1]
        page += 1


def feature_pages(url: str, size: int = 2000, get: Callable[[str], dict] = get_json) -> Iterator[dict]:
    """Attribute rows of a feature layer, ``size`` at a time, until it is empty or says that nothing is left."""
    start = 0
    while True:
        query = {"where": "1=1", "outFields": "*", "returnGeometry": "false", "f": "json", "resultOffset": start, "resultRecordCount": min(size, 2000)}
        js = get(f"{url}/query?{urllib.parse.urlencode(query)}")
        rows = [f["attributes"] for f in js.get("features", [])]
        yield from rows
        if not rows or not js.get("exceededTransferLimit"):
            return
        start += len(rows)


class _Part(InputPartition):
    def __init__(self, query: dict[str, str]):
        self.query = query


class PagedSource(DataSource):
    """``spark.read.format("paged_list").option("url", ...).option("queries", json list of parameter dicts).load()``: query, row (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return "query string, row string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_Part(q) for q in json.loads(self.options.get("queries", "[{}]"))]

    def read(self, partition):
        canned = json.loads(self.options["canned"]) if "canned" in self.options else None
        get = (lambda url: canned.get(url, {})) if canned is not None else get_json
        for row in list_pages(self.options["url"], partition.query, get):
            yield json.dumps(partition.query, sort_keys=True), json.dumps(row, sort_keys=True)


def downloads(packages: dict, formats: tuple[str, ...] = ("CSV", "XLSX", "XLS", "JSON")) -> list[dict]:
    """Files that a catalogue search answers with, one a URL, in the formats that can be read."""
    seen, out = set(), []
    for package in packages.get("result", {}).get("results", []):
        for r in package.get("resources", []):
            if (r.get("format") or "").upper() in formats and r.get("url") and r["url"] not in seen:
                seen.add(r["url"])
                out.append({"package": package.get("name"), "title": package.get("title"), "url": r["url"], "format": r["format"].upper()})
    return out


def panorama_row(point: dict, answer: dict) -> dict:
    """One row for a point that was asked for a panorama; without one, the status and nulls."""
    ok = answer.get("status") == "OK"
    at = answer.get("location", {}) if ok else {}
    return {
        "point_id": point["point_id"], "unit_id": point.get("unit_id"), "query_lat": point.get("lat"), "query_lon": point.get("lon"), "bearing": point.get("bearing"),
        "pano_id": answer.get("pano_id") if ok else None, "date": answer.get("date") if ok else None, "pano_lat": at.get("lat"), "pano_lon": at.get("lng"), "is_current": True if ok else None, "status": answer.get("status", "NO_ANSWER"),
    }


def walk_services(root: str, get: Callable[[str], dict] = get_json) -> list[dict]:
    """Layers of a map server: folders are walked, services that refuse (498, 499) are listed with their code."""
    out, todo = [], [""]
    while todo:
        folder = todo.pop()
        js = get(f"{root}/{folder}?f=json".replace("//?", "/?"))
        if code := js.get("error", {}).get("code"):
            out.append({"service": folder, "layer": None, "status": str(code)})
            continue
        todo += [f for f in js.get("folders", [])]
        for s in js.get("services", []):
            own = get(f"{root}/{s['name']}/{s['type']}?f=json")
            if code := own.get("error", {}).get("code"):
                out.append({"service": s["name"], "layer": None, "status": str(code)})
            out += [{"service": s["name"], "layer": x.get("name"), "status": "ok"} for x in own.get("layers", [])]
    return out


def domain_requests(root: str, provinces: list[str]) -> list[dict[str, str]]:
    """What to ask for the districts of every province, one request a province."""
    return [{"province_code": c, "url": f"{root}/domain/type/kabbyprov/prov/{c}00"} for c in provinces]


def domain_codes(answers: list[tuple[str, dict]]) -> list[dict]:
    """Unit codes and names out of (province, domain list) answers: four digits that don't end in 00; the first of a repeated code."""
    out = {}
    for province, js in answers:
        data = js.get("data")
        for r in data[1] if isinstance(data, list) and len(data) > 1 and isinstance(data[1], list) else []:
            code = str(r.get("domain_id"))
            if len(code) == 4 and code.isdigit() and not code.endswith("00"):
                out.setdefault(code, {"unit_code": code, "unit_name": r.get("domain_name"), "province_code": province})
    return list(out.values())


def year_calls(years: list[str | int], most: int = 2) -> list[str]:
    """Year ids as the parameter of as few calls as the service allows: at most ``most`` a call."""
    ids = [str(y) for y in years]
    return [";".join(ids[i : i + most]) for i in range(0, len(ids), most)]


def cached(get: Callable[[str], dict], read: Callable[[str], str | None], write: Callable[[str, str], None], good: Callable[[dict], bool] = bool) -> Callable[[str], dict]:
    """``get`` that keeps raw answers: what was answered well is read, not asked again; poor answers are asked anew."""
    def ask(url: str) -> dict:
        held = read(url)
        if held and good(js := json.loads(held)):
            return js
        js = get(url)
        write(url, json.dumps(js, ensure_ascii=False))
        return js

    return ask
