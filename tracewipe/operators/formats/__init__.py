"""Container grammars. Each module splits a file into pieces; what a piece becomes is table-driven.

A ``clean(data, policy, report)`` function returns the cleaned bytes, notes what it dropped in the
report and raises ``ScrubError`` for a file it cannot read.
"""
