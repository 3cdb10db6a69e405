"""Declared schemas of the tables, and the constants of the model registry."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

UNIT_TYPES = ("chapter", "section", "article", "prologue", "paragraph", "letter_item", "num_item")

SPARSE = "struct<indices: array<bigint>, values: array<double>>"
LAW_UNITS = "id string, parent_id string, unit_type string, content string, meta_info map<string,string>"
ENRICHED = LAW_UNITS + f", hypothetical_questions array<string>, content_vector array<float>, question_vectors array<array<float>>, sparse_vector {SPARSE}, question_sparse_vectors array<{SPARSE}>"
POINTS = f"point_id string, unit_id string, unit_type string, vector_type string, content string, question_text string, parent_id string, dense array<float>, sparse {SPARSE}"
RAW_ENTITIES = "surface_form string, category_label string, source_unit_id string, ord bigint"
CHUNKS = "unit_id string, content string, parent_id string, source_strategy string, raw_score double, fusion_score double, cross_encoder_score double"
OUTBOX = "batch_id bigint, task string, unit_ids array<string>"

UNIT_COLUMNS = ("id", "parent_id", "unit_type", "content", "meta_info")


@dataclass(frozen=True)
class Settings:
    """Sizes and model parameters. The public defaults of the models and stores that the engine stands in for."""

    batch: int = 50
    questions: int = 3
    dimension: int = 768
    top_k: int = 5
    prefetch: int = 2
    rrf_k: int = 2
    k1: float = 1.2
    b: float = 0.75
    avgdl: float = 256.0
    min_cluster_size: int = 2
    min_samples: int = 1
    max_hops: int = 1
    edge_types: tuple[str, ...] = ("PART_OF",)

    @classmethod
    def load(cls, spark=None) -> Settings:
        """The defaults, but for what ``spark.lawloom.<name>`` says in the session, or else ``LAWLOOM_<NAME>`` in the environment.

        A value is read as the kind of its default; lists are split at commas; one that can't be read is an error.
        """
        given = {}
        for f in fields(cls):
            text = spark.conf.get(f"spark.lawloom.{f.name}", None) if spark is not None else None
            text = os.environ.get(f"LAWLOOM_{f.name.upper()}") if text is None else text
            if text is not None:
                kind = type(f.default)
                given[f.name] = tuple(x.strip() for x in text.split(",") if x.strip()) if kind is tuple else kind(text)
        return cls(**given)


SETTINGS = Settings()
