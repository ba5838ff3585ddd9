"""Incremental (Structured Streaming) forms of batch operators.

The reference has no stream processing; the only operator here is the
period count (AGG7) kept up to date as new files arrive.
"""
