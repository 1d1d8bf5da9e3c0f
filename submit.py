"""Launcher for spark-submit: python files of the package go along as vocale.zip (see README)."""

from vocale.run import main

main()
