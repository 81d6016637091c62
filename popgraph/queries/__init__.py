"""Registered queries: operators bound to the driver's tables, each with its SQL twin."""
