"""Operators for building training corpora.

One module per operator, each with its own general interface; ``catalog`` holds
the registered queries and their SQL.  Nothing else in the library imports this
package.
"""
