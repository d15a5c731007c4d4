"""Sitegauge: web page audit over tables of pages, as Spark DataFrame operators."""
