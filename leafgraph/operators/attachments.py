"""Attachments of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions.paths import canonical_path, file_name, path_ext
from leafgraph.functions.texts import is_blank, trim_ws
from leafgraph.operators.ingest import on_disk

#: Extension to MIME type (fixed values): the usual web, office, picture, sound, film, font and archive types; anything else is application/octet-stream.
MIME = {
    ".7z": "application/x-7z-compressed", ".aac": "audio/aac", ".ai": "application/postscript", ".aif": "audio/x-aiff", ".aiff": "audio/aiff", ".apk": "application/vnd.android.package-archive",
    ".avi": "video/x-msvideo", ".avif": "image/avif", ".bin": "application/octet-stream", ".bmp": "image/bmp", ".c": "text/plain", ".cab": "application/vnd.ms-cab-compressed", ".css": "text/css", ".csv": "text/csv",
    ".dll": "application/x-msdownload", ".doc": "application/msword", ".docm": "application/vnd.ms-word.document.macroEnabled.12", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".dot": "application/msword", ".dotx": "application/vnd.openxmlformats-officedocument.wordprocessingml.template", ".eot": "application/vnd.ms-fontobject", ".eps": "application/postscript",
    ".epub": "application/epub+zip", ".flv": "video/x-flv", ".gif": "image/gif", ".gz": "application/x-gzip", ".h": "text/plain", ".htm": "text/html", ".html": "text/html", ".ico": "image/x-icon",
    ".ics": "text/calendar", ".jar": "application/java-archive", ".jpe": "image/jpeg", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".js": "text/javascript", ".json": "application/json", ".jsx": "text/jscript",
    ".m3u": "audio/x-mpegurl", ".m4a": "audio/mp4", ".m4v": "video/mp4", ".map": "text/plain", ".markdown": "text/markdown", ".md": "text/markdown", ".mid": "audio/mid", ".midi": "audio/mid",
    ".mjs": "text/javascript", ".mov": "video/quicktime", ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".mpeg": "video/mpeg", ".mpg": "video/mpeg", ".mpp": "application/vnd.ms-project",
    ".odp": "application/vnd.oasis.opendocument.presentation", ".ods": "application/vnd.oasis.opendocument.spreadsheet", ".odt": "application/vnd.oasis.opendocument.text", ".oga": "audio/ogg", ".ogg": "video/ogg",
    ".ogv": "video/ogg", ".otf": "font/otf", ".pdf": "application/pdf", ".png": "image/png", ".pps": "application/vnd.ms-powerpoint", ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".ps": "application/postscript", ".qt": "video/quicktime", ".rar": "application/octet-stream", ".rtf": "application/rtf",
    ".rtx": "text/richtext", ".sh": "application/x-sh", ".svg": "image/svg+xml", ".svgz": "image/svg+xml", ".swf": "application/x-shockwave-flash", ".tar": "application/x-tar", ".tex": "application/x-tex",
    ".tgz": "application/x-compressed", ".tif": "image/tiff", ".tiff": "image/tiff", ".tsv": "text/tab-separated-values", ".ttf": "application/x-font-ttf", ".txt": "text/plain", ".vcf": "text/x-vcard",
    ".vsd": "application/vnd.visio", ".wasm": "application/wasm", ".wav": "audio/wav", ".webm": "video/webm", ".webp": "image/webp", ".wma": "audio/x-ms-wma", ".wmv": "video/x-ms-wmv",
    ".woff": "application/font-woff", ".woff2": "font/woff2", ".xhtml": "application/xhtml+xml", ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xml": "text/xml", ".xsd": "text/xml", ".xsl": "text/xml", ".xslt": "text/xml", ".z": "application/x-compress", ".zip": "application/x-zip-compressed",
}


def newest_first(attachments: DataFrame) -> DataFrame:
    return attachments.orderBy("graph_id", F.desc("created_utc"), F.desc("id"))


def attachment_list(doc_ids: DataFrame, attachments: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, then the columns of attachments): what each document's graph has, newest first; any member sees all."""
    own = doc_ids.join(members.withColumnRenamed("file_id", "doc_id"), "doc_id").join(attachments, "graph_id")
    return own.orderBy("doc_id", F.desc("created_utc"), F.desc("id")).select("doc_id", *attachments.columns)


def latest_export(attachments: DataFrame) -> DataFrame:
    """The newest export of each graph; equal times: the largest id."""
    order = Window.partitionBy("graph_id").orderBy(F.desc("created_utc"), F.desc("id"))
    return attachments.where("kind = 'export'").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def dedupe_attachment_refs(requests: DataFrame, attachments: DataFrame) -> DataFrame:
    """Requests (graph_id, source_path, ...) whose path isn't attached to the graph as a reference yet; case counts."""
    there = attachments.where("kind = 'reference'").select("graph_id", "source_path")
    return requests.join(there, ["graph_id", "source_path"], "left_anti").select(requests.columns)


def content_type(attachments: DataFrame) -> DataFrame:
    table = attachments.sparkSession.createDataFrame(list(MIME.items()), "__ext string, __mime string")
    j = attachments.join(F.broadcast(table), F.lower(path_ext(F.col("file_name"))) == F.col("__ext"), "left")
    return j.select(*[attachments[c] for c in attachments.columns], F.coalesce("__mime", F.lit("application/octet-stream")).alias("content_type"))


def validate_attachments(requests: DataFrame, files: DataFrame, inventory: DataFrame, members: DataFrame, attachments: DataFrame) -> DataFrame:
    """Requests (doc_id, kind, path, file_name, size_bytes) with full_path, name, stored_name and reason.

    reference: unknown_document, blank, invalid, not_on_disk, attached. upload: unknown_document, empty. An upload's name
    defaults to `file` and its stored name is a new unique one with the same extension (differs in each run).
    """
    known = files.select(F.col("id").alias("__id")).distinct()
    disk = on_disk(inventory).select(F.col("path").alias("__path"))
    there = attachments.where("kind = 'reference'").select(F.col("graph_id").alias("__ag"), F.col("source_path").alias("__ap")).distinct()
    graph = members.select(F.col("file_id").alias("__f"), F.col("graph_id").alias("__g"))
    rows = requests.withColumn("full_path", canonical_path(trim_ws(F.col("path"))))
    j = rows.join(known, F.col("doc_id") == F.col("__id"), "left").join(disk, F.col("full_path") == F.col("__path"), "left").join(graph, F.col("doc_id") == F.col("__f"), "left")
    j = j.join(there, (F.col("__g") == F.col("__ag")) & (F.col("full_path") == F.col("__ap")), "left")
    unknown = F.when(F.col("__id").isNull(), "unknown_document")
    reference = unknown.when(is_blank(F.col("path")), "blank").when(F.col("path").contains("\u0000"), "invalid").when(F.col("__path").isNull(), "not_on_disk").when(F.col("__ap").isNotNull(), "attached")
    upload = unknown.when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty")
    name = F.when(F.col("kind") == "reference", file_name(F.col("full_path"))).otherwise(F.when(is_blank(F.col("file_name")), "file").otherwise(F.col("file_name")))
    out = j.withColumn("name", name).withColumn("reason", F.when(F.col("kind") == "reference", reference).when(F.col("kind") == "upload", upload).otherwise("unknown_kind"))
    stored = F.when((F.col("kind") == "upload") & F.col("reason").isNull(), F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), path_ext(F.col("name"))))
    return out.select(*[requests[c] for c in requests.columns], "full_path", "name", stored.alias("stored_name"), "reason")
