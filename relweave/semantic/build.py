"""Indexes of all entities of a catalog that declare text to search."""

from __future__ import annotations

import warnings
from collections.abc import Collection

from relweave.semantic.base import Router
from relweave.semantic.tfidf import TfIdf
from relweave.sources.catalog import Catalog


def build_semantic(catalog: Catalog, folder: str | None = None, only: Collection[str] | None = None, rebuild: bool = False) -> Router:
    """A TF-IDF index of each entity with ``semantic_text_fields``; below ``folder``, if one is named, they are written once and read again later.

    Ids are the primary key, else the first column (with a warning).
    """
    backends = {}
    for e in catalog.schema.entities:
        if not e.semantic_text_fields or (only is not None and e.name not in only):
            continue
        key = e.primary_key
        if key is None:
            key = catalog.columns(e.name)[0]
            warnings.warn(f"entity {e.name} has no single primary key; ids are taken from {key}", stacklevel=2)
        path = f"{folder}/{e.name}" if folder else None
        if path and not rebuild and _exists(catalog, f"{path}/idf/_SUCCESS"):
            backends[e.name] = TfIdf.read(catalog.spark, path, e.name, list(e.semantic_text_fields))
            continue
        index = TfIdf.build(catalog.table(e.name), e.name, key, list(e.semantic_text_fields))
        if path:
            index.write(path)
            index = TfIdf.read(catalog.spark, path, e.name, list(e.semantic_text_fields))
        backends[e.name] = index
    return Router(backends)


def _exists(catalog: Catalog, path: str) -> bool:
    context = catalog.spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p)
