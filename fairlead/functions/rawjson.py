"""Reading untyped JSON through VARIANT, keeping absent, null and wrong type apart.

The accessors return Spark SQL text, so a whole validation becomes a few
expressions that Catalyst parses, shares and compiles.
"""

from __future__ import annotations


class Raw:
    """Accessors over one VARIANT column (or lambda variable)."""

    def __init__(self, doc: str):
        self.doc = doc

    def at(self, path: str | None) -> str:
        return f"try_variant_get({self.doc}, '$.{path}', 'variant')" if path else self.doc

    def kind(self, path: str | None = None) -> str:
        """Type name of a value: null when absent, VOID for JSON null."""
        return f"schema_of_variant({self.at(path)})"

    def text(self, path: str) -> str:
        """The value if it is a JSON string, else null."""
        return f"CASE WHEN {self.kind(path)} = 'STRING' THEN try_variant_get({self.doc}, '$.{path}', 'string') END"

    def cast(self, kind: str) -> str:
        """The whole value as ``kind``, null when it cannot be."""
        return f"try_variant_get({self.doc}, '$', '{kind}')"

    def number(self, path: str) -> str:
        """The value if it is a finite JSON number, else null."""
        value = f"try_variant_get({self.doc}, '$.{path}', 'double')"
        return f"CASE WHEN {is_number(self.kind(path), value)} THEN {value} END"

    def absent(self, path: str) -> str:
        return f"{self.at(path)} IS NULL"

    def is_block(self, path: str | None = None) -> str:
        """An object or array, as opposed to a scalar, JSON null or nothing.

        Tested by casts: naming the type of a whole object would walk all of it.
        """
        where = f"$.{path}" if path else "$"
        return (
            f"(try_variant_get({self.doc}, '{where}', 'map<string, variant>') IS NOT NULL "
            f"OR try_variant_get({self.doc}, '{where}', 'array<variant>') IS NOT NULL)"
        )

    def shown(self, path: str) -> str:
        """Printable value for a rejection reason."""
        return (
            f"CASE WHEN {self.at(path)} IS NULL THEN 'undefined' "
            f"ELSE coalesce(try_variant_get({self.doc}, '$.{path}', 'string'), 'null') END"
        )


def is_number(kind: str, value: str) -> str:
    """Whether a value of this kind is a number and, as double, finite."""
    return f"({kind} IN ('BIGINT', 'DOUBLE') OR {kind} LIKE 'DECIMAL%') AND abs({value}) < double('Infinity')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(value: str, allowed: list[str]) -> str:
    return f"coalesce({value} IN ({', '.join(quoted(a) for a in allowed)}), false)"


def blank(value: str) -> str:
    return f"coalesce(length({value}), 0) = 0"


def first_reason(checks: list[tuple[str, str]]) -> str:
    """CASE text: the reason (SQL text) of the first failing check, null when all pass."""
    return "CASE " + " ".join(f"WHEN {bad} THEN {reason}" for bad, reason in checks) + " END"


def iso_timestamp(text: str) -> str:
    """ISO-8601 text to timestamp, null when it is anything else."""
    shape = r"^\\d{4}(-\\d{2}(-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,9})?)?\\s?(Z|[+-]\\d{2}:?\\d{2})?)?)?)?$"
    # Only an offset is rewritten, and a text that ends in Z has none.
    colon = f"CASE WHEN endswith({text}, 'Z') THEN {text} ELSE regexp_replace({text}, '(:\\\\d{{2}}.*[+-]\\\\d{{2}})(\\\\d{{2}})$', '$1:$2') END"
    return f"CASE WHEN {text} RLIKE '{shape}' THEN try_cast({colon} AS timestamp) END"
