"""galley.sources"""
