"""Operators for preparing training text at corpus scale.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
