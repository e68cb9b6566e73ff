"""factloom: evidence analytics on Spark DataFrames.

Raw pages, article feeds and search leads about companies go in; ranked, auditable evidence tables
come out.  Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a ``Column -> Column`` function, and takes its as-of date as a parameter.
"""

__version__ = "0.1.0"
