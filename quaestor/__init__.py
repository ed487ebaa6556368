"""Transaction ledger, anti-money-laundering and data-trust operators on PySpark."""

__version__ = "0.1.0"
