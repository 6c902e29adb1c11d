"""Streams.

The estimation operators need whole tables.  Fitted transforms are projections, though, so ``TransformSpec.apply`` takes a
streaming DataFrame as it is; nothing more is needed here.
"""
