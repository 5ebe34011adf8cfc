"""Parcel-scale property and neighbourhood analytics on Spark DataFrames."""
