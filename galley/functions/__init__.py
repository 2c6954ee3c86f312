"""galley.functions"""
