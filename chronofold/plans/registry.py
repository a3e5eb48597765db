"""User functions with declared inputs, and a line-by-line command reader over the block tables."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame


class Registry:
    """Column builders by name, pinned to the hash of their source; they see only the inputs that they declare."""

    def __init__(self):
        self.known: dict[str, tuple[Callable, tuple[str, ...], str]] = {}

    def register(self, name: str, build: Callable[..., Column], inputs: Iterable[str], pinned: str | None = None) -> str:
        """Adds a function; a pinned hash that differs from its source's is an error.  Returns the hash."""
        found = hashlib.sha256(inspect.getsource(build).encode()).hexdigest()
        if pinned is not None and pinned != found:
            raise ValueError(f"{name} is not the function that was pinned")
        self.known[name] = (build, tuple(inputs), found)
        return found

    def apply(self, df: DataFrame, name: str, output: str) -> DataFrame:
        """Adds the function's column to df."""
        build, inputs, _ = self.known[name]
        missing = [c for c in inputs if c not in df.columns]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        return df.withColumn(output, build(*[df[c] for c in inputs]))


def commands(lines: Iterable[str], tools: dict[str, Callable[..., DataFrame]], vql: Callable[[str], DataFrame], most: int = 1000) -> Iterator[str]:
    """Answers JSON lines {"cmd": "schemas" | "vql" | "call", ...} with JSON lines; errors are answers too.

    At most `most` rows of a result are brought to the reader; `more` says whether there are others.
    """
    for line in lines:
        try:
            asked, more = json.loads(line), False
            if asked["cmd"] == "schemas":
                answer = {name: list(inspect.signature(f).parameters) for name, f in tools.items()}
            else:
                made = vql(asked["text"]) if asked["cmd"] == "vql" else tools[asked["name"]](**asked.get("args", {}))
                answer = [json.loads(x) for x in made.limit(most + 1).toJSON().collect()]
                answer, more = answer[:most], len(answer) > most
            yield json.dumps({"ok": True, "result": answer} | ({"more": True} if more else {}))
        except Exception as e:  # a bad command must not end the reader
            yield json.dumps({"ok": False, "error": str(e)[:300]})
