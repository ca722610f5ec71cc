"""What the engine raises. A session survives all of these."""


class EngineError(Exception):
    """Base of the engine's own errors."""


class ParseError(EngineError):
    """The text is no statement of the dialect."""


class BindError(EngineError):
    """A name, a type or a combination of clauses has no meaning against the catalog."""
