"""Mobility analytics as Spark DataFrame functions: pings -> stays -> places -> venues -> scenarios."""

__version__ = "0.1.0"
