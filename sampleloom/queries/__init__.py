"""The reference's operators as queries over the driver's tables.

The tables stand in for audio: embeddings are PCM chunks, events an irregular
signal, line items packets, orders timeline members, parts and suppliers
requests and sources, conversations chapters, pages byte sources.
"""

from importlib import import_module

from sampleloom.registry import QUERIES

for _family in ("signal", "timeline", "packets", "planner", "service", "text", "streams", "relational", "media"):
    import_module(f"sampleloom.queries.{_family}")

__all__ = ["QUERIES"]
