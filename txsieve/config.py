"""Settings of a deployment: where messages, tables and checkpoints live."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class JobConfig:
    kafka_servers: str = "localhost:9092"
    fail_on_data_loss: bool = True
    jdbc_url: str = ""
    jdbc_driver: str = ""
    jdbc_user: str = ""
    jdbc_password: str = field(default="", repr=False)

    @classmethod
    def from_json(cls, path: str) -> JobConfig:
        with open(path, encoding="utf-8") as file:
            return cls(**json.load(file))

    def require(self, *names: str) -> JobConfig:
        """Raise unless the named settings are filled in."""
        missing = [name for name in names if not getattr(self, name)]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        return self
