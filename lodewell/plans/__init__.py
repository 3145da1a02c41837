"""Registered queries; importing the package registers all of them."""

from lodewell.plans import loads as loads
