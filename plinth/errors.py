"""Errors that a caller can act on."""


class PlinthError(Exception):
    """Base of the library's errors."""


class EmptyQuery(PlinthError):
    pass


class UnknownColumn(PlinthError):
    pass


class UnknownOperator(PlinthError):
    pass


class BadBox(PlinthError):
    pass


class BadInput(PlinthError):
    pass


class WrongType(PlinthError):
    pass
