"""A small JSON service over one run: stages, edits and files, for a user interface.

``Service.handle`` is the whole of it; ``serve`` puts it behind the standard library's
HTTP server.  A run keeps its tables under one folder that Spark can write.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from formweave.api import Engine
from formweave.operators import extract
from formweave.plans import template as T
from formweave.sources import artifacts as S
from formweave.sources.pdf import pdf_words

#: Records that an answer shows at most; all are in the run's folder.
SHOWN = 100
TABLES = ("phrases", "fields", "template", "extracted")


class Service:
    """One run: its phrases, fields, template and records are tables under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, engine: Engine | None = None):
        self.spark, self.folder, self.engine = spark, folder.rstrip("/"), engine or Engine()
        self.routes = {
            ("POST", "/process/phrase"): self.process_phrase,
            ("POST", "/process/fields"): self.process_fields,
            ("POST", "/process/template"): self.process_template,
            ("POST", "/process/extract"): self.process_extract,
            ("POST", "/save/template"): self.save_template,
            ("POST", "/api/add_fields"): self.add_fields,
            ("POST", "/api/remove_fields"): self.remove_fields,
            ("POST", "/api/remove_template_node"): self.remove_template_node,
            ("POST", "/api/modify_template_node"): self.modify_template_node,
            ("POST", "/cleanup"): self.cleanup,
            ("GET", "/files"): self.files,
            ("GET", "/files/bounding-box"): self.bounding_boxes,
            ("GET", "/file/read"): self.read_file,
        }

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        """Status and answer; a request that lacks something is 400, an unknown route or a missing table 404."""
        route = self.routes.get((method, path))
        if route is None:
            return 404, {"error": f"no route {method} {path}"}
        try:
            return 200, route(body or {})
        except FileNotFoundError as e:
            return 404, {"error": str(e)}
        except (KeyError, ValueError) as e:
            return 400, {"error": f"{type(e).__name__}: {e}"}

    # stages

    def process_phrase(self, body: dict) -> dict:
        """Phrases of a folder of PDF files, or of CSV files of words."""
        path = body["path"]
        words = pdf_words(self.spark, path, body.get("pages")) if body.get("kind") == "pdf" else S.read_words(self.spark, path)
        phrases = self.engine.extract_phrase(words, body.get("ground"), pages=body.get("pages"))
        phrases.write.mode("overwrite").parquet(self._at("phrases"))
        sizes = self._phrases().groupBy("doc_id").agg(F.count("*").alias("phrases"), F.max("page").alias("pages")).orderBy("doc_id").limit(SHOWN)
        return {"documents": [r.asDict() for r in sizes.collect()], "cost": self.engine.cost}

    def process_fields(self, body: dict) -> dict:
        found = self.engine.predict_field(self._phrases(), body.get("vision", []), body.get("pages", 5))
        return self._keep_fields(found)

    def process_template(self, body: dict) -> dict:
        return self._keep_template(self.engine.predict_template(self._phrases(), body.get("fields") or self._fields()))

    def process_extract(self, body: dict) -> dict:
        """All records go to the run's folder; the answer shows the first ones and their number."""
        nested = extract.nest(self.engine.extract_data(self._phrases(), self._template()))
        nested.write.mode("overwrite").parquet(self._at("extracted"))
        kept = self.spark.read.parquet(self._at("extracted"))
        shown = kept.orderBy("doc_id", "id").limit(int(body.get("shown", SHOWN)))
        rows = shown.select("doc_id", "id", F.to_json("content").alias("content")).collect()
        return {"records": [{"doc_id": r.doc_id, "id": r.id, "content": json.loads(r.content)} for r in rows], "count": kept.count(), "cost": self.engine.cost}

    # edits

    def save_template(self, body: dict) -> dict:
        return self._keep_template(T.from_json(json.dumps(body["template"])))

    def add_fields(self, body: dict) -> dict:
        fields, unknown = self.engine.add_fields(self._fields(), body["fields"], self._phrases())
        return self._keep_fields(fields) | {"not_found": unknown}

    def remove_fields(self, body: dict) -> dict:
        fields, unknown = self.engine.remove_fields(self._fields(), body["fields"], self._phrases())
        return self._keep_fields(fields) | {"not_found": unknown}

    def remove_template_node(self, body: dict) -> dict:
        return self._keep_template(self.engine.remove_template_node(self._template(), body["node_ids"]))

    def modify_template_node(self, body: dict) -> dict:
        return self._keep_template(self.engine.modify_template_node(self._template(), body["node_id"], body["type"], body["fields"]))

    def cleanup(self, body: dict) -> dict:
        return {"deleted": [t for t in TABLES if S.delete_artifact(self.spark, self._at(t))]}

    # files

    def files(self, body: dict) -> dict:
        return {"files": [t for t in TABLES if self._exists(t)]}

    def bounding_boxes(self, body: dict) -> dict:
        """The phrases of a document, and of one of its pages if asked, with their boxes."""
        rows = self._phrases().where(F.col("doc_id") == body["doc_id"])
        if "page" in body:
            rows = rows.where(F.col("page") == int(body["page"]))
        return {"phrases": [json.loads(r.json) for r in S.phrases_json(rows).orderBy("phrase_idx").collect()]}

    def read_file(self, body: dict) -> dict:
        """The fields or the template, as they are kept."""
        name = body["name"]
        if name not in ("fields", "template"):
            raise ValueError(f"{name!r} is a table; ask for its stage")
        return {"name": name, "content": self._text(name)}

    # tables

    def _at(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _exists(self, table: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(table))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _need(self, table: str) -> str:
        if not self._exists(table):
            raise FileNotFoundError(f"the run has no {table} yet")
        return self._at(table)

    def _text(self, table: str) -> str:
        return "".join(r["value"] for r in self.spark.read.text(self._need(table), wholetext=True).collect()).strip()

    def _keep(self, table: str, text: str) -> None:
        S.delete_artifact(self.spark, self._at(table))
        S.write_string(self.spark, text, self._at(table))

    def _phrases(self) -> DataFrame:
        return self.spark.read.parquet(self._need("phrases"))

    def _fields(self) -> list[str]:
        return json.loads(self._text("fields"))

    def _template(self) -> T.Template:
        return T.from_json(self._text("template"))

    def _keep_fields(self, fields: list[str]) -> dict:
        self._keep("fields", json.dumps(fields))
        return {"fields": fields, "cost": self.engine.cost}

    def _keep_template(self, template: T.Template) -> dict:
        self._keep("template", T.to_json(template))
        return {"template": [asdict(n) for n in template], "cost": self.engine.cost}


def serve(service: Service, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the service; ``serve_forever`` runs it.  GET takes its body from the query, POST from JSON."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: dict) -> None:
            status, answer = service.handle(self.command, urlsplit(self.path).path, body)
            text = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def do_GET(self) -> None:
            self._answer(dict(parse_qsl(urlsplit(self.path).query)))

        def do_POST(self) -> None:
            self._answer(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"))

        def log_message(self, *args) -> None:
            """Requests are not logged."""

    return ThreadingHTTPServer((host, port), Handler)
