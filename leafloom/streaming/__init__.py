"""leafloom.streaming"""
