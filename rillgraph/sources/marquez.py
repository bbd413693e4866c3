"""A batch data source of OpenLineage events from a Marquez server: spark.read.format("marquez").option("url", ...).load().

One partition for each namespace and page of jobs; each reads the runs of its jobs and gives one event for each job. Rows:
(path, text), the form that ``documents.events`` reads.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _get(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=30) as r:
        return json.load(r)


class Page(InputPartition):
    def __init__(self, namespace: str, offset: int):
        self.namespace, self.offset = namespace, offset


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"].rstrip("/") + "/api/v1"
        self.namespace, self.page, self.runs = options.get("namespace"), int(options.get("page", 100)), int(options.get("runs", 5))

    def partitions(self):
        spaces = [self.namespace] if self.namespace else [n["name"] for n in _get(f"{self.url}/namespaces")["namespaces"]]
        out = []
        for s in spaces:
            total = _get(f"{self.url}/namespaces/{urllib.parse.quote(s, safe='')}/jobs?limit=1").get("totalCount", 1)
            out += [Page(s, at) for at in range(0, max(1, total), self.page)]
        return out

    def read(self, partition):
        space = urllib.parse.quote(partition.namespace, safe="")
        for job in _get(f"{self.url}/namespaces/{space}/jobs?limit={self.page}&offset={partition.offset}")["jobs"]:
            runs = _get(f"{self.url}/namespaces/{space}/jobs/{urllib.parse.quote(job['name'], safe='')}/runs?limit={self.runs}")["runs"]
            if any(r.get("state") == "COMPLETED" for r in runs):
                event = {"eventType": "COMPLETE", "job": {"namespace": partition.namespace, "name": job["name"]}, "inputs": job.get("inputs", []), "outputs": job.get("outputs", [])}
                yield f"marquez/{partition.namespace}/{job['name']}.json", json.dumps(event)


class Marquez(DataSource):
    """Register with spark.dataSource.register(Marquez)."""

    @classmethod
    def name(cls):
        return "marquez"

    def schema(self):
        return "path string, text string"

    def reader(self, schema):
        return Reader(self.options)
