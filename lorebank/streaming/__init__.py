"""lorebank.streaming"""
