"""Search services over HTTP as tables: each distinct value is asked for once, with retries, and failures are rows too."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

FOUND = "source string, query string, pos int, n_results int, id string, resource string, name string, error string"


def fetched(url: str, timeout: float) -> dict:
    """The JSON that a URL gives; an answer other than success is an error."""
    request = urllib.request.Request(url, headers={"Accept": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class Service:
    """Where and how one knowledge base is searched; ``attempts`` tries, the kth failure waits k times ``delay`` seconds."""

    source: str
    endpoint: str
    limit: int = 5
    language: str = "en"
    timeout: float = 10.0
    attempts: int = 3
    delay: float = 1.0

    def url(self, query: str) -> str:
        if self.source == "DBpedia":
            asked = {"query": query, "maxResults": self.limit, "format": "json"}
        else:
            asked = {"action": "wbsearchentities", "search": query, "language": self.language, "limit": self.limit, "format": "json", "origin": "*"}
        return f"{self.endpoint}?{urllib.parse.urlencode(asked)}"

    def entries(self, answer: dict) -> list[tuple]:
        """(id, resource, name) of each result as it was sent; a name that is no string is none."""
        text = lambda x: x if isinstance(x, str) else None
        if self.source == "DBpedia":
            return [(None, text(next(iter(d.get("resource") or []), None)), text(d.get("label"))) for d in answer["docs"]]
        return [(text(d.get("id")), None, text(d.get("label"))) for d in answer["search"]]

    def ask(self, query: str, fetch: Callable[[str, float], dict] = fetched) -> list[tuple]:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.entries(fetch(self.url(query), self.timeout))
            except Exception:
                if attempt == self.attempts:
                    raise
                time.sleep(self.delay * attempt)
        return []


def labelled(name: Column, resource: Column, entity: Column) -> Column:
    """A result's label: its name, else its resource or id, else Unknown."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(name), some(resource), some(entity), F.lit("Unknown"))


def search(values: DataFrame, services: list[Service], tasks: int = 8, fetch: Callable[[str, float], dict] = fetched) -> tuple[DataFrame, DataFrame]:
    """kb_search for values(value), and failures(source, query, error): queries that no attempt answered.

    The answers are written once, so no query is sent again when the tables are read.  ``tasks`` bounds how many
    requests run at a time.
    """
    asked = values.select("value").where("value is not null").distinct().repartition(tasks)

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for query in rows["value"]:
                for service in services:
                    try:
                        found = service.ask(query, fetch)
                        out += [(service.source, query, i, len(found), *entry, None) for i, entry in enumerate(found)]
                    except Exception as e:
                        out.append((service.source, query, None, 0, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])
            yield frame.astype({"pos": "Int32", "n_results": "int32"})

    rows = stored(asked.mapInPandas(run, FOUND))
    uri = F.when(F.col("source") == "DBpedia", F.coalesce("resource", F.lit(""))).otherwise(F.concat(F.lit("http://www.wikidata.org/entity/"), F.coalesce("id", F.lit(""))))
    label = labelled(F.col("name"), F.col("resource"), F.col("id"))
    answers = rows.where("error is null").select("source", "query", "pos", "n_results", uri.alias("uri"), label.alias("label"))
    return answers, rows.where("error is not null").select("source", "query", "error")
