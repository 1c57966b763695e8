"""Errors that the operators raise."""


class ContractError(ValueError):
    """A data contract is violated."""
