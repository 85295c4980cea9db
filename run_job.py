"""Entry point for spark-submit."""

from txsieve.cli import main

main()
