"""Registered queries by input, each beside the SQL it is compared with."""

from goldseam.jobs import conversations, events, evolution, layers, matches, squads, tables

REGISTRY = (matches, squads, events, conversations, tables, layers, evolution)
