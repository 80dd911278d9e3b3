"""medallion: Spark-native medallion ingest, cleaning and entity clustering.

The main entry points, importable from the package root:

* sources: ``read_source``, ``read_json_records``
* sinks: ``write_sink``, ``upsert``
* cleaning and roll-ups: ``preprocess``, ``rollup``, ``top_k``
* clustering: ``kmeans_clusters``, ``silhouette``, ``pca_2d``, ``rank_labels``
* jobs: ``ingest``, ``slum_report``, ``electricity_report``, ``run_all``
* streaming: ``stream_ingest``
"""

__version__ = "0.1.0"

_EXPORTS = {
    "read_source": "medallion.sources.readers",
    "read_json_records": "medallion.sources.json_docs",
    "write_sink": "medallion.sinks.writers",
    "upsert": "medallion.sinks.upsert",
    "preprocess": "medallion.operators.clean",
    "rollup": "medallion.operators.rollup",
    "top_k": "medallion.operators.rollup",
    "kmeans_clusters": "medallion.operators.cluster",
    "silhouette": "medallion.operators.cluster",
    "pca_2d": "medallion.operators.cluster",
    "rank_labels": "medallion.operators.cluster",
    "ingest": "medallion.plans.ingest",
    "slum_report": "medallion.plans.reports",
    "electricity_report": "medallion.plans.reports",
    "run_all": "medallion.plans.reports",
    "stream_ingest": "medallion.streaming.landing",
}


def __getattr__(name):
    """Import on first use, so ``import medallion`` stays light."""
    if name in _EXPORTS:
        import importlib
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'medallion' has no attribute {name!r}")


__all__ = sorted(_EXPORTS)
