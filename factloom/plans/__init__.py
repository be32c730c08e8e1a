"""Proof queries over the supplied tables; importing the package registers all of them."""

from . import contracts, frameworks, proofs, relations, scalars, states, structures  # noqa: F401
