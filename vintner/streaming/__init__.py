"""Streaming use of the stateless operators.

The reference has no streaming. The row-wise operators here (cleaning casts,
status stamp, hash split, expression scoring) carry no state, so the same
functions apply to a ``readStream`` frame unchanged.
"""
