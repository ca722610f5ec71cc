"""The syntax tree; `str` of a predicate or an expression is its text."""

from __future__ import annotations

from dataclasses import dataclass, field

INT, DOUBLE, STRING = "Int", "Double", "String"


@dataclass(frozen=True)
class Column:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal:
    value: int | float | str
    kind: str

    def __str__(self) -> str:
        return "'" + self.value.replace("'", "\\'") + "'" if self.kind == STRING else str(self.value)


Operand = Column | Literal


@dataclass(frozen=True)
class Binary:
    """left op right, where right is all that follows: the dialect has one level and groups to the right."""

    op: str
    left: Expression
    right: Expression

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Negative:
    operand: Expression

    def __str__(self) -> str:
        return f"-({self.operand})"


Expression = Column | Literal | Binary | Negative


def columns_of(node: Expression | Comparison | tuple) -> list[str]:
    """The names in an expression, a comparison or a sequence of these, each once, in order."""
    if isinstance(node, Column):
        return [node.name]
    if isinstance(node, Literal):
        return []
    parts = node if isinstance(node, tuple) else (node.operand,) if isinstance(node, Negative) else (node.left, node.right)
    return list(dict.fromkeys(name for part in parts for name in columns_of(part)))


@dataclass(frozen=True)
class Comparison:
    left: Operand
    op: str
    right: Operand

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


#: A conjunction of disjunctions.
Any = tuple[Comparison, ...]
All = tuple[Any, ...]


def predicate_text(terms: All) -> str:
    return " AND ".join("(" + " OR ".join(map(str, term)) + ")" for term in terms)


@dataclass(frozen=True)
class Sum:
    expression: Expression
    distinct: bool = False


@dataclass(frozen=True)
class TableRef:
    table: str
    alias: str


@dataclass(frozen=True)
class Select:
    tables: tuple[TableRef, ...]
    where: All
    columns: tuple[str, ...] = ()
    sum: Sum | None = None
    distinct: bool = False
    group_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]
    layout: str  # heap, sorted or tree
    sort_by: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Insert:
    file: str
    table: str


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class SetOutput:
    target: str  # NONE, STDOUT or a file


@dataclass(frozen=True)
class Exit:
    pass


Statement = Select | CreateTable | Insert | DropTable | SetOutput | Exit
