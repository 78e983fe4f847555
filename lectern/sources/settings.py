"""Settings from the session, else from the environment, else their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    model_provider: str = "rules"
    upload_dir: str = "./uploads"
    temperature: float = 0.7
    chat_parsed_text_limit: int = 150_000
    max_files: int = 3
    timeout_seconds: int = 300

    @classmethod
    def of(cls, spark: SparkSession | None = None, environment: dict[str, str] | None = None) -> Settings:
        """``spark.lectern.<name>`` of the session, else ``LECTERN_<NAME>``, else the default; unknown names are ignored."""
        env = os.environ if environment is None else environment
        found = {}
        for f in fields(cls):
            said = (spark.conf.get(f"spark.lectern.{f.name}", None) if spark else None) or env.get(f"LECTERN_{f.name.upper()}")
            if said is not None:
                found[f.name] = type(f.default)(said)
        return cls(**found)
